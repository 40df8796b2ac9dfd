"""Cross-tokenizer alignment: where two tokenizers' tokens of one text end together, as a monoid of fragments.

A fragment is what a byte range of a document says of its alignment: tokens before the first place in it where
tokens of both kinds end (open prefix), the groups between such places (closed), tokens after the last (open
suffix).  A token belongs to the range in which it ends, so common ends are seen within one range.  Fragments
compose associatively: the suffix of one and the prefix of the next are one group, or still open.  Short documents
are one fragment, made of their pieces'; long ones are cut into byte ranges that any task may take, and their
fragments are composed in a tree."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Recent, held, materialise, ship
from .packing import Encoder

#: A space before which both tokenizers end a token: no piece of either goes on from a character that isn't a
#: space into a space, and a space goes with what follows it.
CUT = re.compile(r"(?<=[^ ▁]) (?=\S)")
#: The same in UTF-8, for characters that are surely not white space in either.
BYTE_CUT = re.compile(rb"(?<=[!-~]) (?=[!-~\xc3-\xdf\xe4-\xf4])")
#: Bytes of a document that are one range, and how far from a range's end a place to begin encoding is sought.
CHUNK, HALO = 1 << 16, 1 << 12
#: Fragments that are composed at once.
FAN = 8
#: Characters and documents whose pairs of tokens are counted together.
BATCH_CHARS, BATCH_DOCS = 1 << 22, 60_000
#: About how many bytes a piece takes that is kept, besides its own characters.
PIECE_BYTES = 400

NONE = np.empty((0, 3), dtype=np.int64)


@dataclass
class Fragment:
    """Tokens are rows of id, start and end in bytes of the document.  codes: pairs of ids, first << 32 | second,
    sorted, of closed groups; times: how often each is linked there.  ok: the tokens' bytes are those of the text."""

    ok: bool = True
    n_a: int = 0
    n_b: int = 0
    n_groups: int = 0
    text: bytes = b""
    codes: np.ndarray = field(default_factory=lambda: NONE[:, 0])
    times: np.ndarray = field(default_factory=lambda: NONE[:, 0])
    cut: bool = False
    head: tuple = (NONE, NONE)
    tail: tuple = (NONE, NONE)


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all pairs of tokens whose byte ranges overlap, by first token; and how many each first has."""
    first = np.searchsorted(b[:, 2], a[:, 1], side="right")
    n = np.searchsorted(b[:, 1], a[:, 2], side="left") - first
    second = np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)
    return (np.repeat(a[:, 0], n) << 32) | b[second, 0], n


def written_groups(a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Tokens in the order in which groups are written, each with the mark behind it: `,` within a side, `|`
    between sides, `;` behind a group; and the group of each."""
    group_a, group_b = np.searchsorted(ends, a[:, 2]), np.searchsorted(ends, b[:, 2])
    last_a, last_b = np.isin(a[:, 2], ends), np.isin(b[:, 2], ends)
    group = np.concatenate([group_a, group_b])
    order = np.argsort(2 * group + (np.arange(len(group)) >= len(a)), kind="stable")
    marks = [f"{i}|" if last else f"{i}," for i, last in zip(a[:, 0].tolist(), last_a.tolist())]
    marks += [f"{i};" if last else f"{i}," for i, last in zip(b[:, 0].tolist(), last_b.tolist())]
    return list(map(marks.__getitem__, order.tolist())), group[order]


def counted(codes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sum of their times."""
    if times is None:
        return np.unique(codes, return_counts=True)
    distinct, where = np.unique(codes, return_inverse=True)
    total = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(total, where, times)
    return distinct, total


def closed(a: np.ndarray, b: np.ndarray) -> tuple[int, bytes, np.ndarray, np.ndarray]:
    """Number of groups, their text, codes and times, of tokens that begin and end together."""
    ends = np.intersect1d(a[:, 2], b[:, 2], assume_unique=True)
    return len(ends), "".join(written_groups(a, b, ends)[0]).encode(), *counted(links(a, b)[0])


def fragment(a: np.ndarray, b: np.ndarray, ok: bool = True) -> Fragment:
    """The fragment of the tokens that end in one byte range."""
    ends = np.intersect1d(a[:, 2], b[:, 2], assume_unique=True)
    if not len(ends):
        return Fragment(ok, len(a), len(b), head=(a, b))
    (a0, a1), (b0, b1) = (np.searchsorted(x[:, 2], ends[[0, -1]], side="right") for x in (a, b))
    n, text, codes, times = closed(a[a0:a1], b[b0:b1])
    return Fragment(ok, len(a), len(b), n, text, codes, times, True, (a[:a0], b[:b0]), (a[a1:], b[b1:]))


def compose(left: Fragment, right: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges.  Associative, and Fragment() is its unit."""
    join = lambda x, y: tuple(np.concatenate(p) for p in zip(x, y))
    ok, n_a, n_b = left.ok and right.ok, left.n_a + right.n_a, left.n_b + right.n_b
    if not left.cut and not right.cut:
        return Fragment(ok, n_a, n_b, head=join(left.head, right.head))
    if not right.cut:
        return Fragment(ok, n_a, n_b, left.n_groups, left.text, left.codes, left.times, True, left.head, join(left.tail, right.head))
    if not left.cut:
        return Fragment(ok, n_a, n_b, right.n_groups, right.text, right.codes, right.times, True, join(left.head, right.head), right.tail)
    n, text, codes, times = closed(*join(left.tail, right.head))
    codes, times = counted(np.concatenate([left.codes, codes, right.codes]), np.concatenate([left.times, times, right.times]))
    return Fragment(ok, n_a, n_b, left.n_groups + n + right.n_groups, left.text + text + right.text, codes, times, True, left.head, right.tail)


def whole(f: Fragment) -> Fragment:
    """A document's fragment with its first group closed; empty if its tokens' bytes aren't those of its text."""
    if not (f.ok and f.cut) or len(f.tail[0]) or len(f.tail[1]):
        return Fragment()
    n, text, codes, times = closed(*f.head)
    codes, times = counted(np.concatenate([codes, f.codes]), np.concatenate([times, f.times]))
    return Fragment(True, f.n_a, f.n_b, n + f.n_groups, text + f.text, codes, times)


def byte_level() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: visible Latin-1 characters stand for themselves, the other
    bytes, in order, for characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


class PlainEncoder(Encoder):
    """Ids without special tokens: their strings in a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.model.encode_special_tokens = True


class Aligner:
    """Aligns pieces of texts, each with a space before it, and keeps what it found for them."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = PlainEncoder(a_path)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = byte_level()
        names = {i: t for t, i in self.a.model.get_vocab(with_added_tokens=True).items()}
        self.a_bytes = [bytes(byte.get(c, 63) for c in names.get(i, "")) for i in range(max(names) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_width, self.b_width = (np.array(list(map(len, t)), dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        self.pieces = Recent(self._compute, PIECE_BYTES)

    def tokens(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of both kinds of all pieces, one behind the other, the pieces' ends, and which pieces' tokens
        have other bytes than the piece."""
        easy = [p for p in pieces if p and not p[0].isspace()]
        found = iter(self.a._compute(easy))
        a_raw = [next(found) if p and not p[0].isspace() else np.array(self.a._ids(" " + p), dtype="<u4").tobytes() for p in pieces]
        b_raw = self.b.encode(pieces, num_threads=1)
        spaced = [b" " + p.encode() for p in pieces]
        a = np.frombuffer(b"".join(a_raw), dtype="<u4").astype(np.int64)
        b = np.fromiter(chain.from_iterable(b_raw), dtype=np.int64, count=sum(map(len, b_raw)))
        size = np.array(list(map(len, spaced)), dtype=np.int64)
        ends = np.cumsum(size)
        bad = np.zeros(len(pieces), dtype=bool)
        for ids, table, width, n in ((a, self.a_bytes, self.a_width, [len(r) // 4 for r in a_raw]), (b, self.b_bytes, self.b_width, list(map(len, b_raw)))):
            at = np.concatenate([[0], np.cumsum(width[ids])])[np.cumsum(n)]
            if (at == ends).all() and b"".join(map(table.__getitem__, ids.tolist())) == b"".join(spaced):
                continue
            stop = np.cumsum(n)
            bad |= [b"".join(map(table.__getitem__, ids[j - k : j].tolist())) != s for j, k, s in zip(stop, n, spaced)]
        if bad.any():
            return a, b, ends, bad, size
        placed = lambda ids, width: np.column_stack([ids, np.cumsum(width[ids]) - width[ids], np.cumsum(width[ids])])
        return placed(a, self.a_width), placed(b, self.b_width), ends, bad, size

    def _compute(self, pieces: list[str]) -> list[tuple | None]:
        """Of each piece: numbers of tokens and groups, the groups' text, and codes of its links; None if its
        tokens have other bytes."""
        out: list[tuple | None] = []
        for start in range(0, len(pieces), 20_000):
            out += self._some(pieces[start : start + 20_000])
        return out

    def _some(self, pieces: list[str]) -> list[tuple | None]:
        a, b, ends, bad, _ = self.tokens(pieces)
        if bad.any():
            good = iter(self._some([p for p, x in zip(pieces, bad) if not x]) if not bad.all() else ())
            return [None if x else next(good) for x in bad]
        common = np.intersect1d(a[:, 2], b[:, 2], assume_unique=True)
        marks, group = written_groups(a, b, common)
        last = np.searchsorted(common, ends)
        mark_stop = np.searchsorted(group, last, side="right").tolist()
        codes, n = links(a, b)
        raw = codes.tobytes()
        a_stop, b_stop = (np.searchsorted(x[:, 2], ends, side="right") for x in (a, b))
        code_stop = (8 * np.concatenate([[0], np.cumsum(n)])[a_stop]).tolist()
        before = lambda x: [0, *x[:-1]]
        n_a, n_b, n_groups = (np.diff(x, prepend=0).tolist() for x in (a_stop, b_stop, last + 1))
        texts = ["".join(marks[i:j]).encode() for i, j in zip(before(mark_stop), mark_stop)]
        links_of = [raw[i:j] for i, j in zip(before(code_stop), code_stop)]
        return list(zip(n_a, n_b, n_groups, texts, links_of))

    def align_all(self, texts: list[str]) -> list[Fragment]:
        """Whole documents' fragments."""
        split = [CUT.split(" " + t) if t and "▁" not in t else [] for t in texts]
        for s in split:
            if s:
                s[0] = s[0][1:]
        self.pieces.need(set().union(*split))
        out = []
        for s in split:
            found = list(map(self.pieces.__getitem__, s))
            if not found or None in found:
                out.append(Fragment())
                continue
            n_a, n_b, n_groups, text, codes = zip(*found)
            codes, times = counted(np.frombuffer(b"".join(codes), dtype=np.int64))
            out.append(Fragment(True, sum(n_a), sum(n_b), sum(n_groups), b"".join(text), codes, times))
        return out

    def align_range(self, near: bytes, at: int, start: int, stop: int) -> Fragment:
        """The fragment of the bytes from start to stop of a document; near: its bytes from `at` on as far as
        tokens of this range may reach, with a place to cut at either end."""
        split = CUT.split(near.decode())
        split[0] = split[0][1:]
        a, b, _, bad, _ = self.tokens(split)
        if bad.any():
            return Fragment(ok=False)
        mine = [x[(x[:, 2] + at > start) & (x[:, 2] + at <= stop)] + [0, at, at] for x in (a, b)]
        return fragment(*mine)


def aligner(a_path: str, b_path: str) -> Aligner:
    return held(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))


def ranges(text: str, chunk: int, halo: int):
    """(at, start, stop, bytes from at on) of the byte ranges of a document, a space before its text counted in.

    Ranges end at multiples of `chunk`, wherever tokens end.  Where no place to begin encoding is within `halo`
    bytes on both sides of such an end, there is none, and the range goes on."""
    full = b" " + text.encode()
    cuts = [(0, 0, 0)]
    for c in range(chunk, len(full), chunk):
        before = [m.start() for m in BYTE_CUT.finditer(full, max(c - halo, 0), c)]
        after = BYTE_CUT.search(full, c, min(c + halo, len(full)))
        if before and after and before[-1] > 0:
            cuts.append((c, before[-1], after.start()))
    cuts.append((len(full), len(full), len(full)))
    for (start, at, _), (stop, _, to) in zip(cuts, cuts[1:]):
        yield at, start, stop, full[at:to]


PARTS = "ok boolean, n_a long, n_b long, n_groups long, text binary, codes binary, times binary, cut boolean, head_a binary, head_b binary, tail_a binary, tail_b binary"
PART_NAMES = [p.split()[0] for p in PARTS.split(", ")]
PART_TYPES = [{"boolean": pa.bool_(), "long": pa.int64(), "binary": pa.binary()}[p.split()[1]] for p in PARTS.split(", ")]


def to_columns(parts: list[Fragment]) -> list[pa.Array]:
    rows = [(f.ok, f.n_a, f.n_b, f.n_groups, f.text, f.codes.tobytes(), f.times.tobytes(), f.cut, *(x.tobytes() for x in (*f.head, *f.tail))) for f in parts]
    return [pa.array(column, type=t) for column, t in zip(zip(*rows) if rows else [()] * len(PART_TYPES), PART_TYPES)]


def to_fragments(batch) -> list[Fragment]:
    out = []
    for ok, n_a, n_b, n_groups, text, codes, times, cut, *open_ in zip(*(batch.column(c).to_pylist() for c in PART_NAMES)):
        sides = [np.frombuffer(x, dtype=np.int64).reshape(-1, 3) for x in open_]
        out.append(Fragment(ok, n_a, n_b, n_groups, text, np.frombuffer(codes, dtype=np.int64), np.frombuffer(times, dtype=np.int64), cut, tuple(sides[:2]), tuple(sides[2:])))
    return out


def long_documents(docs: DataFrame, a_path: str, b_path: str, chunk: int, halo: int) -> DataFrame:
    """doc_id and the fragment of every one of docs(doc_id, text): byte ranges are dealt out, aligned apart, and
    composed FAN at a time until one is left."""

    def cut(batches):
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
                for k, (at, start, stop, near) in enumerate(ranges(text, chunk, halo)):
                    row = (key, doc_id, k, at, start, stop, near)
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, cut_shape)], schema=cut_shape)

    cut_shape = pa.schema([(c, pa.int64()) for c in ("key", "doc_id", "k", "at", "start", "stop")] + [("near", pa.binary())])

    def align(batches):
        for batch in batches:
            parts = [aligner(a_path, b_path).align_range(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("near", "at", "start", "stop")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "doc_id", "k")), *to_columns(parts)], ["key", "doc_id", "k", *PART_NAMES])

    def merge(key, table):
        table = table.sort_by("k").combine_chunks()
        out = Fragment()
        for f in to_fragments(table):
            out = compose(out, f)
        return pa.Table.from_arrays([table.column(c).slice(0, 1) for c in ("key", "doc_id", "up")] + to_columns([out]), names=["key", "doc_id", "k", *PART_NAMES])

    shape = f"key long, doc_id long, k long, {PARTS}"
    rows = docs.withColumn("key", F.monotonically_increasing_id())
    rows = rows.mapInArrow(cut, "key long, doc_id long, k long, at long, start long, stop long, near binary")
    parts = materialise(rows.repartition("key", "k").mapInArrow(align, shape))
    most = parts.agg(F.max("k")).first()[0] or 0
    while most > 0:
        up = parts.withColumn("up", F.floor(F.col("k") / FAN))
        parts = up.groupBy("key", "up").applyInArrow(merge, shape)
        most //= FAN
    return parts


#: Documents and pairs of tokens of one batch, in one row: pairs in order; for each, in how many documents it is;
#: for each of these, its place in the batch and how often the pair is linked there.
BATCH = "batch long, docs array<struct<doc_id: long, n_a: long, n_b: long, n_groups: long, n_links: long, groups_sha256: string, groups: string>>, codes binary, holders binary, place binary, times binary"
_DOC = pa.struct([(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups_sha256", pa.string()), ("groups", pa.string())])
_BATCH = pa.schema([("batch", pa.int64()), ("docs", pa.list_(_DOC)), *[(c, pa.binary()) for c in ("codes", "holders", "place", "times")]])


def batch_row(number: int, rows: list[tuple], groups: bool) -> pa.RecordBatch:
    """One batch of (doc_id, whole fragment)."""
    docs = []
    for doc_id, f in rows:
        text = f.text[:-1]
        digest = hashlib.sha256(text).hexdigest() if text else ""
        docs.append(dict(doc_id=doc_id, n_a=f.n_a, n_b=f.n_b, n_groups=f.n_groups, n_links=int(f.times.sum()), groups_sha256=digest, groups=text.decode() if groups else None))
    codes = np.concatenate([NONE[:, 0], *(f.codes for _, f in rows)])
    place = np.repeat(np.arange(len(rows), dtype=np.uint16), [len(f.codes) for _, f in rows])
    order = np.argsort(codes, kind="stable")
    distinct, holders = np.unique(codes, return_counts=True)
    times = np.concatenate([NONE[:, 0], *(f.times for _, f in rows)])[order]
    values = [number, docs, distinct.tobytes(), holders.astype(np.int32).tobytes(), place[order].tobytes(), times.astype(np.int32).tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, _BATCH)], schema=_BATCH)


def align_tokens(docs: DataFrame, a_path: str, b_path: str, groups: bool = False, chunk: int = CHUNK, halo: int = HALO) -> DataFrame:
    """Alignment of two tokenizers' tokens of every text of docs(doc_id, text).  A row per row of docs: doc_id, n_a,
    n_b (tokens), n_groups (stretches between places where tokens of both end), n_links (pairs of tokens whose bytes
    overlap), n_best (links to a partner that the first token has in as many documents as any), count_sum (over
    links, the number of documents that hold the pair linked), groups_sha256 of the groups as `a1,a2|b1;a3|b2,b3`,
    and with groups=True that text.

    a_path: a byte-level vocabulary of tokenizers, given a space and the text; b_path: a sentencepiece model, given the
    text, which puts a space before it.  Special strings in texts are plain text.  Null and empty texts, and those
    whose tokens' bytes differ from a space and the text, have no tokens: zeros and ''.

    Texts are read once.  Pairs are gathered in batches of documents, and the table of pairs by batch, which is
    much smaller, is what is joined with the counts, so no pair is hot.  Texts above `chunk` bytes are dealt out by
    byte ranges (a stretch without a safe place to cut stays in one range); their digest takes all groups of the
    document in one row.  Equal rows count as documents of their own; a null doc_id is kept; further columns are
    left aside, whatever their names; an empty table gives no row."""
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    is_long = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))

    def batches_of(found):
        """Batches of (doc_id, fragment, characters), numbered by task."""
        task, n, rows, size = TaskContext.get().partitionId(), 0, [], 0
        for doc_id, f, chars in found:
            rows.append((doc_id, f))
            size += chars
            if size >= BATCH_CHARS or len(rows) == BATCH_DOCS:
                yield batch_row(task << 32 | n, rows, groups)
                n, rows, size = n + 1, [], 0
        if rows:
            yield batch_row(task << 32 | n, rows, groups)

    def short(batches):
        def found():
            for batch in batches:
                ids, texts = batch.column("doc_id").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
                start, size = 0, 0
                for i, t in enumerate(texts, 1):
                    size += len(t)
                    if size >= BATCH_CHARS // 4 or i == len(texts):
                        yield from zip(ids[start:i], aligner(a_path, b_path).align_all(texts[start:i]), map(len, texts[start:i]))
                        start, size = i, 0

        return batches_of(found())

    def long(batches):
        return batches_of((i, whole(f), len(f.text)) for batch in batches for i, f in zip(batch.column("doc_id").to_pylist(), to_fragments(batch)))

    table = docs.filter(~is_long).mapInArrow(short, BATCH).unionByName(long_documents(docs.filter(is_long), a_path, b_path, chunk, halo).mapInArrow(long, BATCH))
    table = materialise(table)

    def pairs_of(batches):
        for batch in batches:
            for number, codes, holders in zip(*(batch.column(c).to_pylist() for c in ("batch", "codes", "holders"))):
                codes = np.frombuffer(codes, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), number)), pa.array(codes), pa.array(np.frombuffer(holders, dtype=np.int32).astype(np.int64))], ["batch", "code", "n"])

    pairs = table.select("batch", "codes", "holders").mapInArrow(pairs_of, "batch long, code long, n long")
    counts = pairs.groupBy("code").agg(F.sum("n").alias("count"))
    # a first token's partners are at most the second vocabulary
    counts = counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy(F.shiftright("code", 32))))
    known = pairs.select("batch", "code").join(counts, "code")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("code")
        count, best = right.column("count").to_numpy(), right.column("best").to_numpy()
        row = {c: left.column(c)[0].as_py() for c in ("docs", "holders", "place", "times")}
        per = np.repeat(np.arange(len(count)), np.frombuffer(row["holders"], dtype=np.int32))
        place, times = np.frombuffer(row["place"], dtype=np.uint16), np.frombuffer(row["times"], dtype=np.int32).astype(np.int64)
        n_best, count_sum = np.zeros(len(row["docs"]), dtype=np.int64), np.zeros(len(row["docs"]), dtype=np.int64)
        np.add.at(n_best, place, times * best[per])
        np.add.at(count_sum, place, times * count[per])
        docs = pa.array(row["docs"], type=_DOC)
        return pa.Table.from_arrays([*docs.flatten(), pa.array(n_best), pa.array(count_sum)], names=[*(f.name for f in _DOC), "n_best", "count_sum"])

    result = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, n_best long, count_sum long"
    out = table.groupBy("batch").cogroup(known.groupBy("batch")).applyInArrow(score, result)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *(["groups"] if groups else []))
