"""Text rules against Python's own regular expressions and hand-written cases."""

import re
import unicodedata

from pyspark.sql import functions as F

from parlance.functions import json as js
from parlance.functions import text as tx


def apply(spark, values, fn, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, " + schema)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_repeats_match_the_regular_expression(spark):
    texts = ["да да да конечно", "the le lele le the", "go on go on go on now", "a b a b", "нет, нет, нет", "", "x x x x x y y y", "von vonvon von Vonder"]
    pattern = re.compile(r"\b(\w+(?:\s+\w+)?)\s+(?:\1\s*){2,}", re.IGNORECASE)
    assert apply(spark, texts, tx.remove_repeats) == [pattern.sub(r"\1", t).strip() for t in texts]


def test_fillers_respect_cyrillic_word_borders(spark):
    got = apply(spark, ["Ну, вот это гнуть надо", "ну как бы короче, решили", "значит", "Э-э, да !! !"], lambda c: tx.clean_fillers(c, "ru"))
    assert got == ["гнуть надо", "решили", "", "да ! !"]


def test_artifacts(spark):
    got = apply(spark, ["1:02:03 да", "22:14 вы оплачиваете?", "Спасибо за просмотр!", "Спасибо за просмотр этого длинного доклада", "  ", "Thank you."], tx.drop_artifacts)
    assert got == ["", "22:14 вы оплачиваете?", "", "Спасибо за просмотр этого длинного доклада", "  ", "Thank you."]


def test_turn_normalisation(spark):
    got = apply(spark, ["— Да.", ", в пятницу", "—, там", "—Да.", "Ага. — что было", "дальше — неизвестно", "foo,, , bar", "Так? —, там"], tx.normalize_turn)
    assert got == ["Да.", "В пятницу", "Там", "—Да.", "Ага. Что было", "Дальше — неизвестно", "Foo, bar", "Так? Там"]


def test_seams(spark):
    cases = [("Hello", "world", 1000), ("I was", "Going", 50), ("I was", "Going", 300), ("Hello,", "World", 100), ("Done.", "next", 0), ("Wait…", "what", 700)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, p string, n string, g int").orderBy("i")
    p, n, g = F.col("p"), F.col("n"), F.col("g")
    got = [tuple(r) for r in df.select(F.concat(p, tx.seam_suffix(p, g)), tx.seam_case(p, n, g)).collect()]
    assert got == [("Hello.", "World"), ("I was", "going"), ("I was", "Going"), ("Hello,", "world"), ("Done.", "Next"), ("Wait…", "What")]


def test_scoring_form_composes_marks(spark):
    raw = ["Ёлка — «тест»!", "café ok", "", "ĭ й"]
    want = [re.sub(r"\s+", " ", "".join(" " if unicodedata.category(c)[0] in "PS" else c for c in unicodedata.normalize("NFC", t).lower().replace("ё", "е"))).strip() for t in raw]
    assert apply(spark, raw, lambda c: tx.scoring_normalise(tx.compose(c))) == want


def test_trailing_punctuation_and_case(spark):
    assert apply(spark, ["да?!", "ну,", "…", "слово…", "a:;", "x", "(ok)."], tx.trailing_punct) == ["?", ",", ".", ".", ";", "", "."]
    assert apply(spark, ["«Да", "нет", "123", "-Ёж"], tx.first_alpha_case) == ["U", "L", None, "U"]


def test_names(spark):
    assert apply(spark, ["Встреча Щукина (1).mp3", "..", "ЪЫ.wav", "a  b.tar.gz"], tx.safe_basename) == ["Vstrecha_Schukina_1", "meeting", "Y", "a_b.tar"]
    assert apply(spark, ["", "a<b>:c. ", None], tx.safe_username) == ["default", "a_b__c", "default"]


def test_thousands(spark):
    got = apply(spark, ["сумма 6407000 рублей", "1000 и 999", "x12345 y", "20250101"], tx.group_thousands)
    assert got == ["сумма 6 407 000 рублей".replace(" 4", " 4").replace(" 0", " 0"), "1 000 и 999", "x12345 y", "20 250 101"]


def test_timestamp_text_with_orphans(spark):
    decoded = "<|startoftranscript|><|ru|><|0.00|> Первый <|4.52|><|4.52|> Второй <|8.10|> хвост"
    df = spark.createDataFrame([(decoded,)], "d string")
    segs = df.select(tx.timestamped_text("d", F.lit(60_000), F.lit(30_000)).alias("s")).first().s
    assert [(s.start_ms, s.end_ms, s.text, s.confidence) for s in segs] == [(60000, 64520, "Первый", 0.9), (64520, 68100, "Второй", 0.9), (68100, 73100, "хвост", 0.7)]


def test_timestamp_text_keeps_the_half_second_floor(spark):
    df = spark.createDataFrame([("<|2.00|> a <|2.00|> lone",)], "d string")
    segs = df.select(tx.timestamped_text("d", F.lit(0), F.lit(30_000)).alias("s")).first().s
    assert [(s.start_ms, s.end_ms) for s in segs] == [(2000, 2500), (2500, 7500)]


def test_json_recovery(spark):
    raw = ['```json\n{"a":1}\n```', 'text {"a": 1} tail', "[1,2]", "nothing", '{"a": }', None]
    assert apply(spark, raw, js.recover_object) == ['{"a":1}', '{"a": 1}', None, None, None, None]


def test_cut_prefers_near_whitespace(spark):
    df = spark.createDataFrame([("hello world again", 0, 1000, 500), ("abcdefghijklmnop", 0, 1000, 500), ("", 0, 10, 5)], "t string, s int, e int, c int")
    got = [r[0] for r in df.select(tx.cut_near(F.col("t"), F.col("s"), F.col("e"), F.col("c"))).collect()]
    assert got == [5, 8, 0]
