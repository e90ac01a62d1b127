"""WARC archives and a two-level capture index.

Tasks write archives of gzip members, one record each, to a shared folder and return where every record lies.  Index lines are sorted by the reversed host
and path of their URL, cut into compressed blocks, and a sparse directory keeps the first key of each block.  A lookup is sorted into the index's
ranges, binary-searches that range's directory, reads the bytes of one block, and then the bytes of one record.

Files carry the task's attempt in their names, and only files named in a finished stage are ever read, so a lost executor leaves nothing behind but an unused file.
Any folder that ``pyarrow.fs`` can open will do (local or shared paths, HDFS, object stores).

Defined results: rows without a page id get no record, null payloads are empty, null URLs are the empty URL; payloads of at least ``REVISIT_BYTES`` bytes that equal that of a later page (larger
id) become revisits of the latest one; rows of one page id, equal or not, are records each, all found by that id; an empty table gives an empty archive.
"""

from __future__ import annotations

import bisect
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.session import checkpoint_dir, cut

REVISIT_BYTES = 1000
FILE_BYTES = 64 << 20
BLOCK_LINES = 256
ROWS = 4096  # Captures sent on at once.
LEVEL = 6


def url_key(url: Column) -> Column:
    """Sort key of a URL: labels of the host in reverse, then the rest, all lower case of A-Z kept as written in the path."""
    url = F.coalesce(url, F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?s)^[^:/?#]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"(?s)^[^:/?#]*://[^/?#]*", "")
    return F.concat(F.concat_ws(",", F.reverse(F.split(host, r"\."))), F.lit(")"), rest)


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def _open_new(folder: str, kind: str):
    """A new file of this task attempt."""
    filesystem, path = _filesystem(folder)
    context = TaskContext.get()
    name = f"{path}/{kind}-{context.partitionId():05d}-{context.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
    filesystem.create_dir(path, recursive=True)
    return filesystem.open_output_stream(name, compression=None), name


def record(page_id: int, url: str, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit has no block but the digest and length of the payload it stands for."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        # JSON text keeps line breaks and other controls in a URL from ending the header.
        f"WARC-Target-URI: {json.dumps(url, ensure_ascii=False)[1:-1]}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = payload if refers_to is None else b""
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def gzip_member(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


CAPTURES = "key string, page_id long, file string, at long, length long"


def _write_records(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    out, name = _open_new(folder, "archive")
                    at = 0
                refers = None if r.refers_to is None else int(r.refers_to)
                raw = gzip_member(record(int(r.page_id), r.url, r.payload.encode("utf-8"), r.digest, int(r.size), refers))
                out.write(raw)
                rows.append((r.key, int(r.page_id), name, at, len(raw)))
                at += len(raw)
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "at", "length"])
        if out is not None:
            out.close()

    return run


def plan_records(pages: DataFrame) -> DataFrame:
    """Pages with key, digest, size and, for revisits, the page they refer to."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.where("page_id is not null").select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), url_key(F.col("url")).alias("key"), payload.alias("payload"),
        F.sha1(F.encode(payload, "UTF-8")).alias("digest"), F.octet_length(payload).cast("long").alias("size"),
    )
    large = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest", "size")
    latest = cut(large.groupBy("digest", "size").agg(F.max("page_id").alias("latest"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    # Payloads stay where they are unless many pages repeat: only ids and digests of repeated pages meet.
    revisits = cut(large.join(latest, ["digest", "size"]).where("page_id < latest").select("page_id", "digest", "size", F.col("latest").cast("string").alias("refers_to")).distinct())  # text: pandas would make nullable ids floats
    return rows.join(revisits, ["page_id", "digest", "size"], "left")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes one record per page; returns the captures: ``key``, ``page_id``, ``file``, ``at``, ``length``."""
    return cut(plan_records(pages).select("page_id", "url", "key", "payload", "digest", "size", "refers_to").mapInPandas(_write_records(folder), CAPTURES))


def _write_index(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name, at, held, found = None, "", 0, [], []

        def flush():
            nonlocal at, held
            block = zlib.compress("\n".join(held).encode("utf-8"), LEVEL)
            out.write(block)
            first = json.loads(held[0])
            found.append((first[0], first[1], name, at, len(block)))
            at, held = at + len(block), []

        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    out, name = _open_new(folder, "index")
                held.append(json.dumps([r.key, int(r.page_id), r.file, int(r.at), int(r.length)]))
                if len(held) == BLOCK_LINES:
                    flush()
        if held:
            flush()
        if out is not None:
            out.close()
            # The directory of this range, found again through the name of its index file.
            filesystem, _ = _filesystem(folder)
            with filesystem.open_output_stream(name + ".directory", compression=None) as d:
                d.write(json.dumps(found).encode("utf-8"))
            yield pd.DataFrame([(found[0][0], found[0][1], name, len(found))], columns=["first_key", "first_page", "file", "blocks"])

    return run


def write_index(captures: DataFrame, folder: str) -> list[tuple[str, int, str]]:
    """Sorts captures by key into ranges, writes blocks and directories, and returns the first key and file of each range (one per task)."""
    # Places too, so that captures of one page may fill several ranges.
    rows = captures.repartitionByRange("key", "page_id", "file", "at").sortWithinPartitions("key", "page_id", "file", "at")
    ranges = rows.mapInPandas(_write_index(folder), "first_key string, first_page long, file string, blocks int").collect()
    return sorted((r["first_key"], r["first_page"], r["file"]) for r in ranges)


def _search(folder: str, ranges: list[tuple[str, int, str]]):
    """Captures of sorted lookups: one directory and one block of the index in memory at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filesystem, _ = _filesystem(folder)
        open_range, directory, starts, handle, open_block, lines = None, [], [], None, None, {}
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.range != open_range:
                    open_range, open_block = r.range, None
                    name = ranges[r.range][2]
                    with filesystem.open_input_file(name + ".directory") as d:
                        directory = json.loads(d.read())
                    starts = [(x[0], x[1]) for x in directory]
                    if handle is not None:
                        handle.close()
                    handle = filesystem.open_input_file(name)
                # Captures of one page may go on over several blocks.
                wanted = (r.key, r.page_id)
                for block in range(max(0, bisect.bisect_left(starts, wanted) - 1), max(1, bisect.bisect_right(starts, wanted))):
                    if block != open_block:
                        open_block = block
                        handle.seek(directory[block][3])
                        lines = {}
                        for line in zlib.decompress(handle.read(directory[block][4])).decode("utf-8").split("\n"):
                            key, page, *place = json.loads(line)
                            lines.setdefault((key, page), []).append((key, page, *place))
                    rows += lines.get(wanted, [])
                    if len(rows) >= ROWS:
                        yield pd.DataFrame(rows, columns=["key", "page_id", "file", "at", "length"])
                        rows = []
            yield pd.DataFrame(rows, columns=["key", "page_id", "file", "at", "length"])

    return run


def lookup(wanted: DataFrame, folder: str, ranges: list[tuple[str, int, str]]) -> DataFrame:
    """All captures of ``key`` and ``page_id`` rows, through the index; asking twice finds them once."""
    if not ranges:
        return wanted.sparkSession.createDataFrame([], CAPTURES)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        firsts = [(k, p) for k, p, _ in ranges]
        for batch in batches:
            keys = list(zip(batch["key"], batch["page_id"], strict=True))
            low = [max(0, bisect.bisect_left(firsts, x) - 1) for x in keys]
            high = [max(0, bisect.bisect_right(firsts, x) - 1) for x in keys]
            yield batch.assign(range=pd.Series([list(range(a, b + 1)) for a, b in zip(low, high, strict=True)], index=batch.index, dtype=object))

    routed = wanted.where("page_id is not null").select("key", "page_id").distinct().mapInPandas(route, "key string, page_id long, range array<int>")
    routed = routed.select("key", "page_id", F.explode("range").alias("range"))
    return routed.repartition("range").sortWithinPartitions("range", "key", "page_id").mapInPandas(_search(folder, ranges), CAPTURES)


READ_COLUMNS = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Records read by byte range; a response's digest and size are taken from its payload, a revisit's from its header."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        filesystem, _ = _filesystem(folder)
        name, handle = None, None
        for batch in batches:
            rows = []
            for r in batch.itertuples(index=False):
                if r.file != name:
                    if handle is not None:
                        handle.close()
                    name, handle = r.file, filesystem.open_input_file(r.file)
                handle.seek(r.at)
                fields, block = parse(zlib.decompress(handle.read(r.length), 31))
                page = int(fields["WARC-Record-ID"][len("<urn:page:") : -1])
                url = json.loads('"' + fields["WARC-Target-URI"] + '"')
                if fields["WARC-Type"] == "revisit":
                    rows.append((page, url, int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"][5:], "revisit", int(fields["WARC-Refers-To"][len("<urn:page:") : -1]), None))
                else:
                    rows.append((page, url, len(block), hashlib.sha1(block).hexdigest(), "response", None, block.decode("utf-8")))
            out = pd.DataFrame(rows, columns=READ_COLUMNS)
            # Ids whole: pandas would make a column of numbers and None floats.
            yield out.assign(refers_to=pd.array([r[5] for r in rows], dtype="Int64"))

    # Ranges of bytes that follow each other are read by one task.
    return captures.repartitionByRange("file", "at").sortWithinPartitions("file", "at").mapInPandas(run, READ)


def new_folder(spark) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
