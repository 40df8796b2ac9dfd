"""Periodic runs: stretches of a text that repeat one sequence of words, by suffix arrays.

A run of smallest period d ends with a branching tandem repeat: two suffixes d words apart, of one document,
that agree in exactly d words.  In the suffix array these two lie in one LCP interval of depth d, in different
children, so one of them is in a child other than the largest.  For every interval the suffixes of those smaller
children are tested by ISA[i + d] and ISA[i - d] lying in the interval, which is n log n tests in all and needs
no tree.  Every square found is rotated left while the words agree, and equal stretches merge into one run."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import WORD, WordIndex, ship

#: Least words of a run, and least repeats of its period.
LEAST_WORDS = 24
LEAST_REPEATS = 3
#: Words whose suffixes are sorted at once; a longer document is taken alone.
BATCH_WORDS = 1 << 18

RUN = "array<struct<start: bigint, length: bigint, period: bigint>>"


def refine(rank: np.ndarray, active: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """One step of prefix doubling: ranks by the first 2h words from those by the first h, and the suffixes
    that still share their rank.  A rank is the number of smaller suffixes."""
    first, second = rank[active].astype(np.int64), rank[active + h].astype(np.int64)
    order = np.argsort((first << 32) | second, kind="stable")
    active, first, second = active[order], first[order], second[order]
    n = len(active)
    new_group = np.ones(n, dtype=bool)
    new_group[1:] = first[1:] != first[:-1]
    new_part = new_group.copy()
    new_part[1:] |= second[1:] != second[:-1]
    at = np.arange(n)
    group, part = np.maximum.accumulate(np.where(new_group, at, 0)), np.maximum.accumulate(np.where(new_part, at, 0))
    out = rank.copy()
    out[active] = first + part - group
    last = np.ones(n, dtype=bool)
    last[:-1] = new_part[1:]
    return out, np.sort(active[~(new_part & last)])


def first_ranks(words: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks by document and first word, and the suffixes that share theirs."""
    _, where, n = np.unique((doc.astype(np.int64) << 32) | words.astype(np.int64), return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - n)[where].astype(np.int32)
    return rank, np.flatnonzero(n[where] > 1)


def repetitive(words: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """Documents in which some `least` words in a row occur twice.  least is a power of two."""
    rank, active = first_ranks(words, doc)
    h = 1
    while h < least and len(active):
        rank, active = refine(rank, active, h)
        h *= 2
    return np.unique(doc[active])


def intervals(lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every border k between suffixes k - 1 and k: first and last suffix of the largest stretch around it
    that agrees in lcp[k] words.  lcp has one border more at either end, with -1."""
    values = lcp.tolist()
    n = len(values)
    left, right = [0] * n, [0] * n
    stack = [0]
    for k in range(1, n):
        v = values[k]
        while values[stack[-1]] > v:
            right[stack.pop()] = k - 1
        top = stack[-1]
        left[k] = left[top] if values[top] == v else top
        stack.append(k)
    return np.array(left), np.array(right)


def find_runs(words: np.ndarray, doc: np.ndarray, least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS):
    """(start, end, period) of all runs in words of several documents, as places in the whole array.

    words: numbers of words; each document ends with a number that it has nowhere else.  doc: document of each."""
    if not len(words):
        return (np.empty(0, dtype=np.int64),) * 3
    rank, active = first_ranks(words, doc)
    steps, h = [(1, rank)], 1
    while len(active):
        rank, active = refine(rank, active, h)
        h *= 2
        steps.append((h, rank))
    n = len(words)
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank] = np.arange(n)
    a, b, same = suffix[:-1], suffix[1:], np.zeros(n - 1, dtype=np.int64)
    for h, r in reversed(steps):
        same += np.where(r[np.minimum(a + same, n - 1)] == r[np.minimum(b + same, n - 1)], h, 0)
    lcp = np.concatenate([[-1], same, [-1]])
    left, right = intervals(lcp)
    # children of one interval: between its left end, its borders and its right end
    border = np.flatnonzero(lcp > 0)
    depth, left, right = lcp[border], left[border], right[border]
    by = np.lexsort((border, depth, left))
    border, depth, left, right = border[by], depth[by], left[by], right[by]
    if not len(border):
        return (np.empty(0, dtype=np.int64),) * 3
    new = np.ones(len(border), dtype=bool)
    new[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    k = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    start = np.concatenate([left[heads], border])
    owner = np.concatenate([k[heads], k])
    by = np.lexsort((start, owner))
    start, owner = start[by], owner[by]
    stop = np.empty_like(start)
    stop[:-1] = start[1:]
    ends = np.flatnonzero(np.append(owner[1:] != owner[:-1], True))
    stop[ends] = right[heads] + 1
    size = stop - start
    biggest = np.lexsort((size, owner))[ends]
    small = np.ones(len(size), dtype=bool)
    small[biggest] = False
    start, size, owner = start[small], size[small], owner[small]
    # the members of the smaller children, each with its interval
    total = int(size.sum())
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    member, owner = suffix[place], np.repeat(owner, size)
    d, lo, hi = depth[heads][owner], left[heads][owner], right[heads][owner]
    found = []
    for first in (member, member - d):
        second = first + d
        other = rank[np.clip(np.where(first == member, second, first), 0, n - 1)]
        ok = (first >= 0) & (second < n) & (other >= lo) & (other <= hi)
        i, p = first[ok], d[ok]
        ok = words[i + p] != words[np.minimum(i + 2 * p, n - 1)]
        found.append((i[ok], p[ok]))
    i, d = (np.concatenate(x) for x in zip(*found))
    end = i + 2 * d
    for h, r in reversed(steps):  # rotate left
        back = np.maximum(i - h, 0)
        i = np.where((i >= h) & (r[back] == r[np.minimum(back + d, n - 1)]), back, i)
    good = end - i >= np.maximum(least_words, least_repeats * d)
    i, end, d = i[good], end[good], d[good]
    by = np.lexsort((d, end, i))  # of one stretch's periods the smallest
    i, end, d = i[by], end[by], d[by]
    keep = np.ones(len(i), dtype=bool)
    keep[1:] = (i[1:] != i[:-1]) | (end[1:] != end[:-1])
    i, end, d = i[keep], end[keep], d[keep]
    by = np.lexsort((d, i))
    return i[by], end[by], d[by]


def runs_of(texts: list[list[bytes]], least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document, given as lists of words, by start, then period."""
    out: list[list] = [[] for _ in texts]
    # a run agrees with itself, one period on, in so many words at least
    again = min(max(least_words - q, (least_repeats - 1) * q) for q in range(1, least_words + 1))
    again = 1 << max(again.bit_length() - 1, 0) if again > 0 else 1
    index = WordIndex()
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    numbers = np.fromiter((index[w] for t in texts for w in t), dtype=np.int32, count=int(sizes.sum())) + 1
    # every document gets an end, numbered 0: no other word of it is
    doc = np.repeat(np.arange(len(texts)), sizes + 1)
    words = np.zeros(len(doc), dtype=np.int32)
    starts = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(doc), dtype=bool)
    inside[starts + sizes] = False
    words[inside] = numbers
    some = repetitive(words, doc, again)
    if not len(some):
        return out
    kept = np.isin(doc, some)
    place = np.flatnonzero(kept)
    for a, b, d in zip(*find_runs(words[kept], doc[kept], least_words, least_repeats)):
        at = place[a]
        k = int(doc[at])
        out[k].append((int(at - starts[k]), int(b - a), int(d)))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    change = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def periodic_runs(docs: DataFrame, name: str = "__periodic", least_words: int = LEAST_WORDS, least_repeats: int = LEAST_REPEATS) -> DataFrame:
    """docs(text, ...) with a column `name` of n_words, runs (start, length, period; by start, then period) and
    collapsed: the words outside the repeats, joined by one space.

    A run is a stretch of words with smallest period q, at least least_words and least_repeats * q words long,
    that can't be extended with that period.  Words are runs of characters other than ASCII white space.
    Documents without some words in a row twice, as each run has, leave before suffixes are sorted in full.
    A map over rows without a shuffle: memory follows a batch of BATCH_WORDS words, or the longest document,
    which is taken whole.  Null, empty and blank texts: no words, no runs, an empty collapsed text.  Equal rows are
    read each for itself; an empty table stays empty; all columns of docs pass, whatever their names."""
    ship(docs.sparkSession)
    shape = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), ("collapsed", pa.string())])

    def found(part: list[list[bytes]]):
        for words, runs in zip(part, runs_of(part, least_words, least_repeats)):
            kept = without_repeats(words, runs) if runs else words
            yield {"n_words": len(words), "runs": [dict(zip(("start", "length", "period"), r)) for r in runs], "collapsed": b" ".join(kept).decode()}

    def scan(texts: pa.Array) -> pa.Array:
        out, part, size = [], [], 0
        for text in texts.cast(pa.binary()).to_pylist():
            words = (text or b"").split()
            if part and size + len(words) > BATCH_WORDS:
                out.append(pa.array(found(part), type=shape))
                part, size = [], 0
            part.append(words)
            size += len(words)
        return pa.concat_arrays([*out, pa.array(found(part), type=shape)])

    def scans(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, scan(batch.column("text"))], [*batch.schema.names, name])

    result = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(f"n_words bigint, runs {RUN}, collapsed string"))])
    return docs.mapInArrow(scans, result)


def with_cycles(docs: DataFrame) -> DataFrame:
    """doc_id, text of docs in which every tenth document, by a checksum of its id, goes on in a cycle of its own
    words from some place on: known runs among natural ones.  A null id's text stays."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10)

    def cycle(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        bound = F.array(F.struct(w.alias("w"), a.alias("a"), p.alias("p")))
        at = lambda s, i: F.when(i >= s["a"], s["a"] + (i - s["a"]) % s["p"]).otherwise(i).cast("int")
        return F.transform(bound, lambda s: F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(s["w"]).cast("long") - 1), lambda i: F.get(s["w"], at(s, i))), " "))[0]

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    once = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, cycle(w)).otherwise(""))[0]
    return docs.select("doc_id", F.when(h % 10 == 0, once).otherwise(F.col("text")).alias("text"))


def run_report(docs: DataFrame, name: str = "__periodic") -> DataFrame:
    """doc_id, number of runs, the run of the greatest exact exponent, and digests of runs and collapsed text of
    periodic_runs(docs).  Without runs: nulls, and the digest of an empty list."""
    got = F.col(name)
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    start = F.get(got["runs"], 0)
    best = F.when(F.size(got["runs"]) > 0, F.aggregate(got["runs"], start, lambda x, y: F.when(more(y, x), y).otherwise(x)))
    lines = F.array_join(F.transform(got["runs"], lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    text = F.when(F.size(got["runs"]) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    out = docs.select("doc_id", F.size(got["runs"]).cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2(got["collapsed"], 256).alias("collapsed_sha256"))
    milli = F.expr("best.length * 1000 div best.period").alias("exponent_milli")
    return out.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")
