"""Two-level primitives against plain loops, with blocks far smaller than the keys."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.operators import ordered as od
from parlance.operators.greedy import greedy_groups, surveyed


def rows_for(seed, n=400, keys=3):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        k = 0 if r.random() < 0.6 else r.randrange(1, keys)
        out.append(k)
    ords = {}
    data = []
    for k in out:
        ords[k] = ords.get(k, 0) + r.randrange(1, 4)
        data.append((k, ords[k], r.randrange(5), r.choice(["a", "b", None])))
    return data


def by_key(data):
    groups = {}
    for row in sorted(data):
        groups.setdefault(row[0], []).append(row)
    return groups


@pytest.mark.parametrize("rows", [3, 7, 1000])
def test_running_totals_and_dense_index(spark, rows):
    data = rows_for(1)
    df = spark.createDataFrame(data, "meeting_id int, ord int, v int, s string")
    tl = od.by_position(rows=rows)
    got = {(r.meeting_id, r.ord): (r.t, r.idx) for r in od.dense_index(od.running_totals(df, tl, {"t": F.col("v")}), tl).collect()}
    want = {}
    for k, rs in by_key(data).items():
        total = 0
        for i, r in enumerate(rs):
            total += r[2]
            want[(k, r[1])] = (total, i)
    assert got == want


@pytest.mark.parametrize("rows", [3, 1000])
def test_neighbours_and_fill(spark, rows):
    data = rows_for(2)
    df = spark.createDataFrame(data, "meeting_id int, ord int, v int, s string")
    tl = od.by_position(rows=rows)
    n = od.neighbours(df, tl, ["ord", "v"], prev="p", following="f")
    got = {(r.meeting_id, r.ord): (r.p and tuple(r.p), r.f and tuple(r.f)) for r in n.collect()}
    f = od.fill(df, tl, forward={"last": F.col("s")}, backward={"next": F.col("s")})
    filled = {(r.meeting_id, r.ord): (r["last"], r["next"]) for r in f.collect()}
    for k, rs in by_key(data).items():
        for i, r in enumerate(rs):
            prev = (rs[i - 1][1], rs[i - 1][2]) if i else None
            nxt = (rs[i + 1][1], rs[i + 1][2]) if i + 1 < len(rs) else None
            assert got[(k, r[1])] == (prev, nxt)
            back = [x[3] for x in rs[: i + 1] if x[3]]
            ahead = [x[3] for x in rs[i:] if x[3]]
            assert filled[(k, r[1])] == (back[-1] if back else None, ahead[0] if ahead else None)


@pytest.mark.parametrize("rows", [3, 1000])
def test_islands(spark, rows):
    data = rows_for(3)
    df = spark.createDataFrame(data, "meeting_id int, ord int, v int, s string")
    isl = od.islands(df, od.by_position(rows=rows), ["v"], lambda p, c: p("v") > c("v"), prev="p", opening="o")
    got = {(r.meeting_id, r.ord): (r.island, r.o.v) for r in isl.collect()}
    for k, rs in by_key(data).items():
        head = None
        for i, r in enumerate(rs):
            if i == 0 or rs[i - 1][2] > r[2]:
                head = r
            assert got[(k, r[1])] == (head[1], head[2])


def test_affine_fold_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(od, "ROWS_PER_BLOCK", 5)
    data = [(1, i, 0.5 + (i % 7) / 10) for i in range(1, 60)]
    df = spark.createDataFrame(data, "k int, ord int, x double")
    first = F.col("ord") == 1
    out = od.affine_in_blocks(df, ["k"], "ord", F.when(first, 0.0).otherwise(0.5), F.when(first, F.col("x")).otherwise(F.col("x") / 2), {}, {}).collect()
    c = data[0][2]
    for _, _, x in data[1:]:
        c = (c + x) / 2
    assert abs(out[0].folded - c) < 1e-12


def loop_groups(rows, absorb):
    out, opened, last = [], None, None
    for r in rows:
        if opened is None or not absorb(opened[1:], last[1:], r[1:]):
            opened = r
        out.append((r[0], opened[0]))
        last = r
    return out


@pytest.mark.parametrize("rows", [4, 17, 100_000])
@pytest.mark.parametrize("rule", ["span", "budget", "speech"])
def test_greedy_groups_match_the_loop(spark, rows, rule):
    r = random.Random(rows)
    data = []
    for k in (1, 2, 3):
        t = 0
        for i in range(1, 160 if k == 1 else 25):
            s = t + r.choice([0, 0, 5, 30])
            e = s + r.choice([0, 3, 10, 25, 60])
            data.append((k, i, s, e))
            t = e
    rules = {
        "span": (lambda o, l, x: x[1] - o[0] <= 40 and x[0] - l[1] <= 20, None),
        "budget": (lambda o, l, x: x[1] - o[0] <= 15, None),
        "speech": (lambda o, l, x: l[1] != o[0] and not (l[1] - o[0] > 5 and (x[1] - o[0] > 50 or l[1] - o[0] > 30)), lambda x: x[0] == x[1]),
    }
    absorb, empty = rules[rule]
    df = spark.createDataFrame(data, "meeting_id int, ord int, s int, e int")
    got = greedy_groups(df, surveyed(rows=rows), ["s", "e"], absorb, empty=empty)
    have = {(x.meeting_id, x.ord): x.group for x in got.collect()}
    for k in (1, 2, 3):
        mine = [d[1:] for d in data if d[0] == k]
        for o, g in loop_groups(mine, absorb):
            assert have[(k, o)] == g, (k, o)
