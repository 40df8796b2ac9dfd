"""Language identification: interpolated Kneser-Ney character models in sorted hash arrays."""

from __future__ import annotations

import pickle
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEEP_BYTES, WordIndex, held, materialise, ship

#: Length of the longest n-grams.
ORDER = 4
#: Expected rows a language at most that models are fit on, and that rejection is calibrated on: the
#: bounds of the two samples.
TRAIN_ROWS, HELD_ROWS = 1_500, 3_000
#: Languages up to which a table of one row for each is broadcast.
FEW = 10_000
#: Characters that a word's model reads; longer words count in parts of this length.
WORD_PART = 40
#: Held texts of a language in one band of lengths, about, and the place from above of the cross-entropy
#: that counts as the band's largest, so that a junk text or two don't raise it.
BAND, ROBUST = 375, 3
#: A text is rejected if its cross-entropy, without its most surprising word, lies this many times as far above
#: its band's median as the band's largest does.
REJECT = 2.0
LETTER = r"\p{L}"
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    """64-bit hash of an n-gram from its first characters' hash and its next character."""
    h = (h ^ (c + np.uint64(1))) * _PRIME
    return h ^ (h >> np.uint64(29))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, each between two blanks, and the word each belongs to."""
    line = "".join([f" {w} " for w in words])
    chars = np.frombuffer(line.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    return chars, owner


def _grams(chars: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n-gram that ends at each place, and whether it lies within one word."""
    h = np.zeros(len(chars), dtype=np.uint64)
    whole = np.zeros(len(chars), dtype=bool)
    if len(chars) >= n:
        part = np.zeros(len(chars) - n + 1, dtype=np.uint64)
        for k in range(n):
            part = _mix(part, chars[k : len(chars) - n + 1 + k])
        h[n - 1 :] = part
        whole[n - 1 :] = owner[n - 1 :] == owner[: len(chars) - n + 1]
    return h, whole


@dataclass
class Model:
    """One language: for each order the sorted hashes of n-grams with their log2 probability,
    and of contexts with the log2 weight of the lower order."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    floor: float
    lengths: np.ndarray = field(default_factory=lambda: np.zeros(0))  # where bands of lengths begin, but the first
    limits: np.ndarray = field(default_factory=lambda: np.array([np.inf]))  # cross-entropy to reject from, by band


def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> tuple[np.ndarray, np.ndarray]:
    hashes, values = table
    if not len(hashes):
        return np.full(len(keys), missing), np.zeros(len(keys), dtype=bool)
    i = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    hit = hashes[i] == keys
    return np.where(hit, values[i], missing), hit


def fit(words: dict[str, int], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney model of words with their counts."""
    names = sorted(words)
    chars, owner = _codes(names)
    weight = np.array([words[w] for w in names], dtype=np.float64)[owner]
    levels = []
    for n in range(1, order + 1):
        h, whole = _grams(chars, owner, n)
        whole &= np.r_[False, owner[1:] == owner[:-1]]  # the leading blank is only context
        context = _grams(chars, owner, n - 1)[0] if n > 1 else np.zeros(len(chars), dtype=np.uint64)
        at = np.flatnonzero(whole)
        keys, first, inverse = np.unique(h[at], return_index=True, return_inverse=True)
        count = np.bincount(inverse, weights=weight[at])
        end = at[first]
        before = np.zeros(len(end), dtype=np.uint64) if n == 1 else context[end - 1]
        shorter = _grams(chars, owner, n - 1)[0][end] if n > 1 else np.zeros(len(end), dtype=np.uint64)
        levels.append([keys, count, before, shorter])
    for n in range(order - 1):  # below the top: in how many contexts an n-gram was seen
        tails, kinds = np.unique(levels[n + 1][3], return_counts=True)
        levels[n][1] = np.maximum(_find((tails, kinds.astype(float)), levels[n][0], 0.0)[0], 1.0)
    size = len(levels[0][0]) + 1
    grams, contexts, lower = [], [], None
    for keys, count, before, shorter in levels:
        ones, twos = (count == 1).sum(), (count == 2).sum()
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        ctx, inverse = np.unique(before, return_inverse=True)
        total, kinds = np.bincount(inverse, weights=count), np.bincount(inverse)
        below = np.full(len(keys), 1.0 / size) if lower is None else np.exp2(_find(lower, shorter, np.log2(1.0 / size))[0])
        p = (np.maximum(count - discount, 0) + discount * kinds[inverse] * below) / total[inverse]
        lower = (keys, np.log2(p))
        grams.append(lower)
        contexts.append((ctx, np.log2(discount * kinds / total)))
    return Model(grams, contexts, float(np.log2(1.0 / size)))


def word_bits(model: Model, words: list[str]) -> np.ndarray:
    """Bits that the model needs for each word with its closing blank."""
    chars, owner = _codes(words)
    todo = np.r_[False, owner[1:] == owner[:-1]]
    logp = np.zeros(len(chars))
    order = len(model.grams)
    hashes = [_grams(chars, owner, n) for n in range(1, order + 1)]
    for n in range(order, 0, -1):
        h, whole = hashes[n - 1]
        at = np.flatnonzero(todo & whole)
        if len(at):
            value, hit = _find(model.grams[n - 1], h[at], 0.0)
            logp[at[hit]] += value[hit]
            todo[at[hit]] = False
            missed = at[~hit]
            context = hashes[n - 2][0][missed - 1] if n > 1 else np.zeros(len(missed), dtype=np.uint64)
            logp[missed] += _find(model.contexts[n - 1], context, 0.0)[0]
    logp[todo] += model.floor
    return np.bincount(owner, weights=-logp, minlength=len(words))


def split_words(text: str) -> list[str]:
    words = text.lower().split()
    if len(text) > WORD_PART and max(map(len, words), default=0) > WORD_PART:
        words = [w[i : i + WORD_PART] for w in words for i in range(0, len(w), WORD_PART)]
    return words


class Scorer:
    """Cross-entropy of texts under every language, with words' scores kept."""

    def __init__(self, models: dict[str, Model]):
        self.source = models  # held, so that its id stands for it alone
        self.names = sorted(models)
        self.models = [models[k] for k in self.names]
        self.reset()

    def reset(self) -> None:
        self.index, self.bits = WordIndex(), np.zeros((len(self.names) + 1, 0))

    def rows(self, texts: list[str]) -> list[np.ndarray]:
        """The words of each text as columns of bits."""
        if self.index.bytes + self.bits.nbytes > KEEP_BYTES:
            self.reset()
        lookup = self.index.__getitem__
        rows = [np.fromiter(map(lookup, split_words(t)), dtype=np.int64) for t in texts]
        if self.index.new:
            new, self.index.new = self.index.new, []
            got = np.vstack([*(word_bits(m, new) for m in self.models), [len(w) + 1.0 for w in new]])
            self.bits = np.hstack([self.bits, got])
        return rows

    def measure(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits by text and language, and characters by text."""
        return self.sums(self.rows(texts))

    def sums(self, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        sums = np.array([self.bits[:, r].sum(axis=1) for r in rows]).reshape(len(rows), len(self.names) + 1)
        return sums[:, :-1], sums[:, -1]

    def steady(self, rows: list[np.ndarray], languages) -> np.ndarray:
        """Cross-entropy of each text in a language without its most surprising word, so that one key, address or
        slip doesn't speak for a short text."""
        out = np.zeros(len(rows))
        for i, (r, k) in enumerate(zip(rows, languages)):
            bits, chars = self.bits[k, r], self.bits[-1, r]
            j = bits.argmax() if len(r) > 1 else None
            total, n = bits.sum(), chars.sum()
            if j is not None:
                total, n = total - bits[j], n - chars[j]
            out[i] = total / max(n, 1.0)
        return out

    def predict(self, texts: list[str]) -> pd.DataFrame:
        rows = self.rows(texts)
        bits, chars = self.sums(rows)
        n = np.maximum(chars, 1)
        entropy = bits / n[:, None]
        best = entropy.argmin(axis=1)
        # weights of evidence from at most 40 characters, so long texts don't all round to 1
        odds = np.exp2(-(entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(n, 40)[:, None])
        low = entropy[np.arange(len(best)), best]
        limit = np.array([self.models[b].limits[np.searchsorted(self.models[b].lengths, k, side="right")] for b, k in zip(best, chars)])
        return pd.DataFrame({"lang": [self.names[i] for i in best], "score": 1 / odds.sum(axis=1), "entropy": low, "rejected": self.steady(rows, best) > limit})


def limits(entropy: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where bands of lengths begin, but the first, and the cross-entropy to reject from in each: held
    texts of one language, by length, in bands of equal numbers.  Fewer than 5 texts reject nothing."""
    if len(entropy) < 5:
        return np.zeros(0), np.array([np.inf])
    order = np.argsort(chars, kind="stable")
    bands = np.array_split(order, max(1, len(order) // BAND))
    out = []
    for band in bands:
        e = np.sort(entropy[band])
        middle = np.median(e)
        out.append(middle + REJECT * max(e[-min(ROBUST, len(e))] - middle, 0.1))
    return np.array([chars[band[0]] for band in bands[1:]], dtype=float), np.array(out)


def _count_words(batches):
    for batch in batches:
        for lang, texts in batch.groupby("lang")["text"]:
            words = Counter(w for t in texts for w in split_words(t))
            yield pd.DataFrame({"lang": lang, "word": list(words), "n": list(words.values())})


def train(docs: DataFrame, rows: int = TRAIN_ROWS, held_rows: int = HELD_ROWS, order: int = ORDER) -> dict[str, Model]:
    """Models of every language in docs(doc_id, text, lang).

    Two samples of about `rows` and `held_rows` rows a language are taken by a hash of doc_id and text, the
    same on every run and apart from each other.  The first makes the models: its words are counted and each
    language's model is fit on the executors.  The second calibrates rejection: executors measure its
    cross-entropies.  To the driver go the models' n-gram tables and two numbers for each held text, no
    text and no word.  Rows without text or lang take no part; repeated rows count as often as they are
    drawn; an empty table gives no model."""
    spark = docs.sparkSession
    ship(spark)
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sizes = materialise(known.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")))
    langs = sizes.count()
    if not langs:
        return {}
    u = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1_000_000_007)) / 1_000_000_007.0
    place = u * F.col("__n")  # as if the language's rows stood in the order of their hashes
    first = F.least(F.lit(float(rows)), 0.8 * F.col("__n"))
    drawn = known.join(F.broadcast(sizes) if langs <= FEW else sizes, "lang").filter(place < first + held_rows)
    drawn = drawn.select("lang", "text", (place >= first).alias("held"))
    sample = materialise(drawn.repartition(spark.sparkContext.defaultParallelism))
    words = sample.filter(~F.col("held")).select("lang", "text").mapInPandas(_count_words, "lang string, word string, n long")

    def fit_one(rows: pd.DataFrame) -> pd.DataFrame:
        model = fit(dict(zip(rows["word"], rows["n"])), order)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "model": [pickle.dumps(model)]})

    fitted = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).groupBy("lang").applyInPandas(fit_one, "lang string, model binary")
    models = {r["lang"]: pickle.loads(r["model"]) for r in fitted.collect()}
    if not models:
        return {}
    shared = spark.sparkContext.broadcast(models)

    def measure(batches):
        loaded = shared.value
        scorer = held(("language", id(loaded)), lambda: Scorer(loaded))
        for batch in batches:
            some = batch[batch["lang"].isin(scorer.names)]
            for start in range(0, len(some), 500):
                part = some.iloc[start : start + 500]
                words = scorer.rows(part["text"].tolist())
                own, chars = scorer.steady(words, [scorer.names.index(k) for k in part["lang"]]), scorer.sums(words)[1]
                yield pd.DataFrame({"lang": part["lang"], "entropy": own, "chars": chars})[chars > 0]

    numbers = sample.filter("held").select("lang", "text").mapInPandas(measure, "lang string, entropy double, chars double").toPandas()
    for lang, part in numbers.sort_values(["lang", "chars", "entropy"]).groupby("lang"):
        models[lang].lengths, models[lang].limits = limits(part["entropy"].to_numpy(), part["chars"].to_numpy())
    return models


def identify(docs: DataFrame, models: dict[str, Model], column: str = "__language") -> DataFrame:
    """docs with a struct column (lang, score, entropy, rejected) from its column text.

    The lowest cross-entropy a character wins, ties to the first language by name.  Null texts and texts
    without a letter: lang `und`, score 0, rejected.  rejected also marks texts that lie further from
    their language than its held texts of that length do.  Very long texts count whole, long words
    in parts.  Without models all is `und`.  A scan without a shuffle: equal rows get equal results,
    an empty table gives an empty one; a column named as the new one is replaced, all others pass."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(models)

    @F.pandas_udf("lang string, score double, entropy double, rejected boolean")
    def guess(texts: pd.Series) -> pd.DataFrame:
        import regex

        if not shared.value:
            return pd.DataFrame({"lang": ["und"] * len(texts), "score": 0.0, "entropy": None, "rejected": True})
        loaded = shared.value
        scorer = held(("language", id(loaded)), lambda: Scorer(loaded))
        some = regex.compile(LETTER).search
        out = pd.DataFrame({"lang": "und", "score": 0.0, "entropy": np.nan, "rejected": True}, index=range(len(texts)))
        values = texts.tolist()
        good = [i for i, t in enumerate(values) if t is not None and some(t)]
        for start in range(0, len(good), 500):
            at = good[start : start + 500]
            out.iloc[at] = scorer.predict([values[i] for i in at]).to_numpy()
        return out.astype({"score": float, "entropy": float, "rejected": bool})

    return docs.withColumn(column, guess("text"))


def trainable(docs: DataFrame) -> DataFrame:
    """Rows that the contract lets the models learn from."""
    return docs.filter(F.col("lang").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) != 2))
