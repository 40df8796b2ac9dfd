"""Best-fit packing by a plan over the histogram of lengths."""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, held, materialise, ship

#: Fixed value: the pre-tokenizer's pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces of Latin letters and common marks: both libraries cut these alike.
PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ.,;:!?*#%$&\n-]+")
#: Characters of texts that are encoded at once.
BATCH_CHARS = 1 << 20
#: A space that starts a new piece: the pre-tokenizer's pattern joins a space to what follows it
#: and never to what stands before, so both sides are encoded apart with the same ids.
CUT = re.compile(r" (?=\S)")


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():  # one character of a byte-level token is one byte
            self.width[i] = len(token)
        self.pieces = Recent(self._compute)
        self.fast = None
        ranks = path.removesuffix(".json") + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def _compute(self, pieces: list[str]) -> list[bytes]:
        """Plain pieces by the same vocabulary's ranks, where these are at hand, which is several times
        faster; all others, as with special strings, by the tokenizer itself."""
        if not self.fast:
            return self._in_lines(pieces, self._ids)
        plain = [bool(PLAIN.fullmatch(p)) for p in pieces]
        some = iter(self._in_lines([p for p, ok in zip(pieces, plain) if ok], self.fast.encode_ordinary))
        rest = iter(self._in_lines([p for p, ok in zip(pieces, plain) if not ok], self._ids))
        return [next(some) if ok else next(rest) for ok in plain]

    def _ids(self, line: str) -> list[int]:
        return self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids

    def _in_lines(self, pieces: list[str], encode) -> list[bytes]:
        """Encode pieces in long lines, and cut the ids where the bytes of each piece end."""
        out = []
        for start in range(0, len(pieces), 2000):
            part = [" " + p for p in pieces[start : start + 2000]]
            ids = np.array(encode("".join(part)), dtype="<u4")
            ends = np.cumsum(self.width[ids])
            stops = np.cumsum([len(p.encode()) for p in part])
            at = 4 * (np.searchsorted(ends, stops) + 1)
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *at[:-1].tolist()], at.tolist())]
        return out

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = [CUT.split(t) for t in texts]
        heads = self.model.encode_batch_fast([s[0] for s in split], add_special_tokens=False)
        rest = [s[1:] for s in split]
        self.pieces.need(set().union(*rest))
        get = self.pieces.__getitem__
        return [np.array(h.ids, dtype="<u4").tobytes() + b"".join(map(get, r)) for h, r in zip(heads, rest)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return held(("encoder", path), lambda: Encoder(path))


def in_bytes(rows, limit: int = BATCH_CHARS):
    """Rows (doc_id, text) in lists of about `limit` characters; null texts become empty."""
    part, size = [], 0
    for doc_id, text in rows:
        text = text if isinstance(text, str) else ""
        part.append((doc_id, text))
        size += len(text)
        if size >= limit:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part, place: one row per piece of a document.

    A document is its ids and then end_id.  If it is longer than the capacity it is cut into
    pieces of that length, the first of which may be shorter.  place numbers the pieces of one
    length within one task (part); the table is written so that both stay as they are."""
    ship(docs.sparkSession)
    tail = np.array([end_id], dtype="<u4").tobytes()

    def encoded(batch):
        for part in in_bytes(zip(batch["doc_id"], batch["text"])):
            for (doc_id, _), ids in zip(part, encoder(path).encode_all([t for _, t in part])):
                yield doc_id, ids + tail

    def cut(batches):
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            rows = []
            for doc_id, ids in encoded(batch):
                n = len(ids) // 4
                start, piece = 0, 0
                while start < n:
                    stop = start + (n - 1) % capacity + 1 if not piece else start + capacity
                    size = stop - start
                    rows.append((doc_id, piece, start, size, zlib.crc32(ids[4 * start : 4 * stop]), part, int(seen[size])))
                    seen[size] += 1
                    start, piece = stop, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])
            yield out.astype({"doc_id": "Int64"})

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"
    return materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, schema))


def plan_best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit, longest first, over counts: (length, first rank, last rank + 1, first sequence, offset).

    Items of `length` with ranks from first to last take the same offset in consecutive
    sequences.  Open sequences are kept as runs of equal room, so the work and the plan's
    size follow the number of lengths, not of items."""
    plan, rooms, runs, opened = [], [], {}, 0

    def put(room: int, first: int, n: int) -> None:
        if room > 0 and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            heapq.heappush(runs[room], (first, n))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                full, more = divmod(left, fit)
                for slot in range(fit):
                    n = full + (slot < more)
                    if n:
                        plan.append((length, rank, rank + n, opened, slot * length))
                        rank += n
                put(capacity - fit * length, opened, full)
                if more:
                    put(capacity - more * length, opened + full, 1)
                opened += full + (more > 0)
                left = 0
                continue
            room = rooms[i]
            first, n = heapq.heappop(runs[room])
            take = min(n, left)
            plan.append((length, rank, rank + take, first, capacity - room))
            rank, left = rank + take, left - take
            if n > take:
                heapq.heappush(runs[room], (first + take, n - take))
            if not runs[room]:
                del runs[room]
                rooms.pop(i)
            put(room - length, first, take)
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Place pieces(length, part, place, ...) into sequences: adds sequence_id and offset.

    The histogram (at most `capacity` rows) alone goes to the driver.  A piece's rank within
    its length is its place within its task plus the pieces of that length in tasks before;
    with length and rank it finds its planned slot in the plan, whose size has the bound that
    lengths set.  No step needs the pieces of one length together, so a length that a third of
    all pieces share is dealt out like others.  An empty table gives an empty result."""
    spark = pieces.sparkSession
    per = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = materialise(per.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = plan_best_fit(counts, capacity)
    steps: dict[int, list] = {}
    for length, first, last, sequence, offset in plan:
        steps.setdefault(length, []).append((first, sequence, offset))
    tables = {k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in steps.items()}
    shared = spark.sparkContext.broadcast(tables)

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
        for k in np.unique(n):
            at = np.flatnonzero(n == k)
            first, to, place = shared.value[int(k)]
            i = np.searchsorted(first, r[at], side="right") - 1
            sequence[at], offset[at] = to[i] + r[at] - first[i], place[i]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    # merged, not broadcast: per grows with the tasks that wrote the pieces
    ranked = pieces.join(per.select("length", "part", "base").hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    out = ranked.withColumn("slot", slot("length", "rank"))
    return out.select(*[c for c in pieces.columns if c not in ("part", "place")], "slot.sequence_id", "slot.offset")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack all of docs(doc_id, text) into as few sequences of at most `capacity` ids as best
    fit finds.  Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null or empty text: a document of end_id alone.  Equal rows are packed each for itself;
    doc_id may be null; further columns are left aside."""
    return pack(token_pieces(docs, path, capacity, end_id), capacity)
