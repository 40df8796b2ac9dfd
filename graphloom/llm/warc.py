"""WARC archives of pages, and their index by an external merge of sorted capture runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from urllib.parse import urlsplit

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, scratch, ship

#: Compressed bytes after which a task starts a new archive.
ARCHIVE_BYTES = 32 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Index entries that a run holds before it is written, and those of one block of a run.
RUN_ROWS, RUN_BLOCK = 50_000, 512
#: Runs that are merged at once; more take further passes.
FAN_IN = 128
#: Index entries that one merging task takes, about, and ranges at most; a task streams, so a range may be long.
MERGE_ROWS, RANGES = 50_000, 1_024
#: Bytes of an archive that are read at once.
READ_BYTES = 1 << 20
#: Time of page 0; every further page is a second later.
EPOCH = datetime(2024, 1, 1, tzinfo=timezone.utc)
END = b"\r\n\r\n"
INDEX = (
    "url_key string, timestamp string, page_id long, archive string, offset long, length long, "
    "record_type string, payload_bytes long, payload_digest string, refers_to long"
)
ORDER = ("url_key", "timestamp", "page_id", "archive", "offset")


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then port, path and query, in lower case;
    without scheme, a leading www., fragment or trailing slash.  Null: empty."""
    if not url:
        return ""
    try:
        u = urlsplit(url.strip())
        host, port = (u.hostname or "").lower(), u.port
    except ValueError:
        return url.strip().lower()
    host = host.removeprefix("www.")
    port = "" if port in (None, 80, 443) else f":{port}"
    path = u.path.rstrip("/").lower() or "/"
    return ",".join(reversed(host.split("."))) + f"{port}){path}" + (f"?{u.query.lower()}" if u.query else "")


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _uri(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(uri: str) -> int | None:
    value = uri.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + END, compresslevel=6, mtime=0)


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member: a response with its payload, or a revisit with headers alone."""
    date = (EPOCH + timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y-%m-%dT%H:%M:%SZ")
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Target-URI", target), ("WARC-Date", date)]
    headers.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _uri(refers_to))]
        return _member(headers + [("Content-Type", "application/http; msgtype=response")], http)
    return _member(headers + [("Content-Type", "application/http; msgtype=response")], http + payload)


def with_revisits(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, digest, size, refers_to, revisit: of pages with equal payloads of at least
    least_bytes that with the largest page_id is the response; others revisit it.  Only
    identifiers and digests meet by digest, with partial aggregates for hot ones."""
    html = F.coalesce("html", F.lit(""))
    light = pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("size"))
    big = light.filter(F.col("size") >= least_bytes)
    first = big.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = big.select("page_id", "digest").join(first, "digest").filter("page_id != refers_to").dropDuplicates(["page_id", "digest"])
    again = again.select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "refers_to")
    full = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("size"))
    full = full.join(again, (F.col("page_id") == F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_page", "r_digest")
    revisit = F.col("refers_to").isNotNull()
    return full.withColumn("revisit", revisit).withColumn("html", F.when(~revisit, F.col("html")))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as gzip WARC files into a shared folder; returns archive, records, bytes.

    Every task attempt writes files of its own names, and only those that the returned table
    names count, so a repeated task does no harm.  folder: any URI that pyarrow.fs opens."""
    ship(pages.sparkSession)

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _files(folder)
        part, out, done = TaskContext.get().partitionId(), None, []
        name = size = records = 0

        def close():
            out.close()
            done.append((name, records, size))

        for batch in batches:
            for r in batch.itertuples(index=False):
                if out is None:
                    files.create_dir(base, recursive=True)
                    name = f"{folder}/pages-{part:06d}-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name.rpartition('/')[2]}", compression=None)
                    size = out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"software: graphloom\r\n"))
                    records = 0
                whole = lambda x: None if pd.isna(x) else int(x)
                payload = b"" if r.revisit else r.html.encode()
                size += out.write(page_record(whole(r.page_id), r.url, payload, r.digest, int(r.size), whole(r.refers_to), bool(r.revisit)))
                records += 1
                if size >= archive_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pd.DataFrame(done, columns=["archive", "records", "bytes"])

    exact = pages.withColumn("page_id", F.col("page_id").cast("string")).withColumn("refers_to", F.col("refers_to").cast("string"))
    return materialise(exact.mapInPandas(write, "archive string, records long, bytes long"))


def read_records(archive: str) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, read in parts: no more than one
    record and READ_BYTES are held."""
    files, path = _files(archive)
    with files.open_input_stream(path, compression=None) as f:
        at, data = 0, f.read(READ_BYTES)
        while data:
            member, parts, length = zlib.decompressobj(31), [], 0
            while not member.eof:
                if not data:
                    raise ValueError(f"{archive} ends within a record")
                parts.append(member.decompress(data))
                length += len(data)
                data = member.unused_data if member.eof else f.read(READ_BYTES)
            length -= len(data)
            head, _, rest = b"".join(parts).partition(END)
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield at, length, headers, rest[: int(headers["Content-Length"])]
            at += length
            data = data or f.read(READ_BYTES)


def captures(archive: str) -> Iterator[tuple]:
    """Index entries of one archive in its order.  Digests and sizes of responses are those of
    the payload as read; a payload that doesn't match its header is an error."""
    for offset, length, h, block in read_records(archive):
        if h["WARC-Type"] == "warcinfo":
            continue
        http, _, payload = block.partition(END)
        digest = base64.b32decode(h["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        size = int(http.rpartition(b": ")[2])
        if h["WARC-Type"] == "response":
            found = hashlib.sha1(payload).hexdigest()
            if found != digest or len(payload) != size:
                raise ValueError(f"{archive} at {offset}: payload and digest differ")
        refers = _page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
        stamp = "".join(c for c in h["WARC-Date"] if c.isdigit())
        yield url_key(h["WARC-Target-URI"]), stamp, _page(h["WARC-Record-ID"]), archive, offset, length, h["WARC-Type"], size, digest, refers


def _place(entry: tuple) -> tuple:
    return entry[0], entry[1], -1 if entry[2] is None else entry[2], entry[3], entry[4]


def merge_runs(runs: list[Iterable[tuple]]) -> Iterator[tuple]:
    """k-way merge of sorted runs by a loser tree: each inner node holds the run that lost
    there, so the next entry takes one comparison a level."""
    feeds = [iter(r) for r in runs]
    k = max(1, len(feeds))
    heads: list = [next(f, None) for f in feeds] + [None] * (k - len(feeds))
    keys = [None if h is None else _place(h) for h in heads]

    def less(a: int, b: int) -> bool:
        return keys[b] is None or (keys[a] is not None and keys[a] <= keys[b])

    losers = [-1] * k
    winner = -1
    for i in range(k):  # each run climbs until it meets an empty node or stays as loser
        at, cur = (i + k) // 2, i
        while at > 0:
            if losers[at] < 0:
                losers[at] = cur
                cur = -1
                break
            if less(losers[at], cur):
                losers[at], cur = cur, losers[at]
            at //= 2
        if cur >= 0:
            winner = cur
    while keys[winner] is not None:
        yield heads[winner]
        heads[winner] = next(feeds[winner], None)
        keys[winner] = None if heads[winner] is None else _place(heads[winner])
        cur, at = winner, (winner + k) // 2
        while at > 0:
            if less(losers[at], cur):
                losers[at], cur = cur, losers[at]
            at //= 2
        winner = cur


#: A block of a sorted run: where it lies, and its first and last place in the order.
BLOCK = "run long, file string, start long, size long, entries long, first binary, last binary"


def _key(entry: tuple) -> bytes:
    """An entry's place as bytes."""
    return json.dumps(_place(entry)).encode()


def _order(key: bytes) -> tuple:
    return tuple(json.loads(key))


class RunWriter:
    """Writes sorted entries as compressed blocks of RUN_BLOCK into a new file, and notes each block."""

    def __init__(self, folder: str, run: int):
        files, base = _files(folder)
        files.create_dir(base, recursive=True)
        self.run, self.blocks, self.part, self.at = run, [], [], 0
        self.file = f"{folder}/run-{uuid.uuid4().hex}"
        self.out = files.open_output_stream(f"{base}/{self.file.rpartition('/')[2]}", compression=None)

    def add(self, entry: tuple) -> None:
        self.part.append(entry)
        if len(self.part) == RUN_BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.part:
            raw = zlib.compress(json.dumps(self.part).encode(), 1)
            self.out.write(raw)
            self.blocks.append((self.run, self.file, self.at, len(raw), len(self.part), _key(self.part[0]), _key(self.part[-1])))
            self.at += len(raw)
            self.part = []

    def close(self) -> list[tuple]:
        self._flush()
        self.out.close()
        return self.blocks


def read_block(file: str, start: int, size: int) -> list[tuple]:
    files, path = _files(file)
    with files.open_input_file(path) as f:
        return [tuple(e) for e in json.loads(zlib.decompress(f.read_at(size, start)))]


def merged_range(blocks: list[tuple], low: tuple | None, high: tuple | None) -> Iterator[tuple]:
    """Entries from low on and below high of several runs, in order.  blocks: (run, first, file, start,
    size), those that may hold such entries; of each run one block is held at a time."""
    runs: dict[int, list[tuple]] = {}
    for run, first, file, start, size in blocks:
        runs.setdefault(run, []).append((_order(first), file, start, size))

    def feed(parts: list[tuple]) -> Iterator[tuple]:
        for _, file, start, size in sorted(parts):
            for entry in read_block(file, start, size):
                place = _place(entry)
                if high is not None and place >= high:
                    return
                if low is None or place >= low:
                    yield entry

    yield from merge_runs([feed(parts) for parts in runs.values()])


def _ranged(blocks: DataFrame, fan_in: int, groups: int) -> tuple[DataFrame, list[tuple]]:
    """blocks with group (of fan_in runs) and range, once for each range that they reach into, and the places
    at which ranges end.  Those are drawn from a sample of blocks of a bounded size."""
    spark = blocks.sparkSession
    total = blocks.agg(F.sum("entries").alias("n"), F.count(F.lit(1)).alias("blocks")).first()
    ranges = min(RANGES, max(1, math.ceil((total["n"] or 0) / MERGE_ROWS)))
    share = min(1.0, 16 * ranges / max(1, total["blocks"]))
    firsts = sorted(_order(r["first"]) for r in blocks.filter(F.pmod(F.xxhash64("file", "start"), F.lit(1_000_000)) < share * 1e6).select("first").collect())
    ends = sorted({firsts[len(firsts) * i // ranges] for i in range(1, ranges)} - {firsts[0]}) if firsts else []
    shared = spark.sparkContext.broadcast(ends)

    @F.pandas_udf("array<int>")
    def reach(first: pd.Series, last: pd.Series) -> pd.Series:
        spans = [range(bisect_right(shared.value, _order(a)), bisect_right(shared.value, _order(b)) + 1) for a, b in zip(first, last)]
        return pd.Series([list(s) for s in spans], dtype=object)

    out = blocks.withColumn("group", F.floor(F.col("run") / fan_in)).withColumn("range", F.explode(reach("first", "last")))
    return out.repartition(groups * (len(ends) + 1), "group", "range").sortWithinPartitions("group", "range"), ends


def _tasks(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[int, int, list[tuple]]]:
    """(group, range, blocks) of rows that come sorted by group and range; a range's block notes are
    some ten bytes for each of its entries' blocks."""
    now, blocks = None, []
    for batch in batches:
        for r in batch.itertuples(index=False):
            if now not in (None, (r.group, r.range)):
                yield *now, blocks
                blocks = []
            now = (r.group, r.range)
            blocks.append((r.run, r.first, r.file, r.start, r.size))
    if now:
        yield *now, blocks


def build_index(archives: DataFrame, folder: str | None = None) -> DataFrame:
    """Globally ordered capture histories of archives(archive): INDEX columns, range and place.

    Tasks read archives and write sorted runs as files of compressed blocks, of which a table notes the
    first and last place.  Ranges of the order then stream their slices of all runs, a block of each run
    at a time, through a loser tree; with more than FAN_IN runs, passes before that merge them in
    groups, range by range as well.  The order ends with page and place, so a URL that holds a third of
    all captures is cut into ranges like any other.  Files belong to the task attempt that the tables
    name, so a lost executor costs its tasks alone."""

    spark = archives.sparkSession
    ship(spark)
    folder = folder or scratch(spark)
    names = [f.split(" ")[0] for f in INDEX.split(", ")]
    noted = [f.split(" ")[0] for f in BLOCK.split(", ")]

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    def runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, part, done = TaskContext.get().partitionId() << 20, [], []

        def write():
            nonlocal number
            part.sort(key=_place)
            out = RunWriter(folder, number)
            for entry in part:
                out.add(entry)
            done.extend(out.close())
            number += 1
            part.clear()

        for batch in batches:
            for archive in batch["archive"]:
                for entry in captures(archive):
                    part.append(entry)
                    if len(part) >= RUN_ROWS:
                        write()
        if part:
            write()
        yield pd.DataFrame(done, columns=noted)

    n = archives.count()
    tasks = min(max(1, n), 4 * spark.sparkContext.defaultParallelism + n // 64)
    blocks = materialise(archives.select("archive").repartition(tasks).mapInPandas(runs, BLOCK))
    number = Window.orderBy("run")  # one row for each run
    while True:
        present = blocks.select("run").distinct()
        groups = math.ceil(present.count() / FAN_IN)
        if groups <= 1:
            break
        dense = present.select("run", (F.row_number().over(number) - 1).cast("long").alias("place"))
        numbered = blocks.join(dense, "run").drop("run").withColumnRenamed("place", "run").select(*noted)
        ranged, ends = _ranged(materialise(numbered), FAN_IN, groups)

        def merge_group(batches: Iterable[pd.DataFrame], ends=ends) -> Iterator[pd.DataFrame]:
            for group, k, parts in _tasks(batches):
                out = RunWriter(folder, int(group))
                for entry in merged_range(parts, ends[k - 1] if k else None, ends[k] if k < len(ends) else None):
                    out.add(entry)
                yield pd.DataFrame(out.close(), columns=noted)

        blocks = materialise(ranged.mapInPandas(merge_group, BLOCK))
    ranged, ends = _ranged(blocks, 1 << 62, 1)

    def merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, k, parts in _tasks(batches):
            out, place = [], 0
            for entry in merged_range(parts, ends[k - 1] if k else None, ends[k] if k < len(ends) else None):
                out.append(entry)
                if len(out) == 10_000:
                    yield frame(out).assign(range=k, place=range(place, place + len(out)))
                    place, out = place + len(out), []
            if out:
                yield frame(out).assign(range=k, place=range(place, place + len(out)))

    return ranged.mapInPandas(merge, INDEX + ", range int, place long")


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as WARC, read the archives back and return their index.

    Null html: an empty payload; null url: an empty key; null page_id: kept as null, and never the
    response that others revisit unless alone.  Equal rows: a record each.  Very long payloads take
    the memory of one record.  Further columns are left aside, also if they are named as those above.
    An empty table: no archive and no rows."""
    folder = folder or scratch(pages.sparkSession)
    return build_index(write_archives(with_revisits(pages, least_bytes), folder))
