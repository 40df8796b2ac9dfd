"""Toxicity by maximum-scoring segments of token log-odds, with extreme-value calibration."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEEP_BYTES, WordIndex, held, materialise, ship

#: Labelled rows of each class that the model is fit on at most (expected): the sample's bound.
TRAIN_ROWS = 6_000
#: Strength of the Dirichlet prior that a word takes from words with the same first letters.
PRIOR = 3.0
#: First letters that words share a prior by.
STEM = 4
#: What each token costs a passage, so that long clean stretches end it.
DRIFT = 1.5
#: The same for stems, which speak for words never seen.
STEM_Z = 6.0
#: Least evidence, in standard deviations, for a word or stem to score at all; high, since
#: hundreds of thousands of words are tried.
LEAST_Z = 4.0
#: A passage counts as significant at this expected number of chance passages in a text of its length.
LEAST_E = 0.05
EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass
class ToxicModel:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0  # lambda of the extreme-value law
    scale: float = 0.1  # K of the extreme-value law
    slope: float = 1.0
    level: float = 0.0

    def token(self, raw: str) -> float:
        word = EDGE.sub("", raw)
        return self.words.get(word, self.stems.get(word[:STEM], 0.0) if len(word) > STEM else 0.0)


def maximal_segments(scores: np.ndarray, drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of scores - drift, in linear time
    (Ruzzo and Tompa).  Stretches without a positive token only move the running sum."""
    at = np.flatnonzero(scores > drift)
    if not len(at):
        return []
    total = np.cumsum(scores - drift)
    found: list[list[float]] = []  # first, last + 1, sum before, sum after, index of the last one with a smaller sum before
    for i in at.tolist():
        before = float(total[i - 1]) if i else 0.0
        item = [i, i + 1, before, float(total[i]), -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= item[2]:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= item[3]:
                item[4] = j
                found.append(item)
                break
            item = [found[j][0], item[1], found[j][2], item[3], -1]
            del found[j:]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in found]


class ToxicScorer:
    """Scores texts; keeps words' scores."""

    def __init__(self, model: ToxicModel):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.index, self.values = WordIndex(), np.zeros(0)

    def tokens(self, text: str) -> np.ndarray:
        rows = np.fromiter(map(self.index.__getitem__, text.lower().split()), dtype=np.int64)
        if self.index.new:
            new, self.index.new = self.index.new, []
            self.values = np.r_[self.values, [self.model.token(w) for w in new]]
        out = self.values[rows]
        if self.index.bytes > KEEP_BYTES:
            self.reset()
        return out

    def passages(self, text: str) -> tuple[list[tuple[int, int, float]], float]:
        """Significant passages (first token, last + 1, score), and the text's evidence: the sum of
        minus the logs of how many chance passages as strong a text of its length would hold;
        without a significant passage that of the strongest, and -1 without any."""
        scores = self.tokens(text)
        base = math.log(self.model.scale * max(len(scores), 1))
        segments = maximal_segments(scores)
        rare = [(s, self.model.rate * s[2] - base) for s in segments]
        strong = [(s, x) for s, x in rare if x >= -math.log(LEAST_E)]
        if strong:
            return [s for s, _ in strong], sum(x for _, x in strong)
        return [], max((min(max(x, 0.0), -math.log(LEAST_E)) for _, x in rare), default=-1.0)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.model.slope * evidence + self.model.level))))


def _log_odds(prior_t: Column, prior_c: Column, n_t: float, n_c: float) -> tuple[Column, Column]:
    """Log-odds of the two classes' rates under Dirichlet priors, and the signed root of the
    likelihood ratio, which is as many standard deviations; from columns toxic and clean."""
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    delta = F.log((t + prior_t) / F.greatest(n_t - t, F.lit(1.0))) - F.log((c + prior_c) / F.greatest(n_c - c, F.lit(1.0)))
    share = n_t / (n_t + n_c)
    gain = t * F.log(F.greatest(t, F.lit(1e-12)) / ((t + c) * share)) + c * F.log(F.greatest(c, F.lit(1e-12)) / ((t + c) * (1 - share)))
    return delta, F.signum(t / (t + c) - share) * F.sqrt(2 * F.greatest(gain, F.lit(0.0)))


def fit_words(counts: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Scores of words and stems from counts(word, toxic, clean), the documents of each class with a word.

    Counting, priors and scores are Spark's; what comes back is the words and stems that score, and the
    known words of scoring stems, which stand for themselves."""
    counts = materialise(counts.withColumn("stem", F.substring("word", 1, STEM)))
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    n_t, n_c = max(float(total["t"] or 0), 1.0), max(float(total["c"] or 0), 1.0)
    share = n_t / (n_t + n_c)
    stems = counts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    delta, z = _log_odds(F.lit(PRIOR * share), F.lit(PRIOR * (1 - share)), n_t, n_c)
    rate = (F.col("toxic") + PRIOR * share) / (F.col("toxic") + F.col("clean") + PRIOR)
    stems = materialise(stems.select("stem", rate.alias("rate"), F.when(F.abs(z) >= STEM_Z, delta).alias("stem_score")))
    delta, z = _log_odds(PRIOR * F.col("rate"), PRIOR * (1 - F.col("rate")), n_t, n_c)
    words = counts.join(stems, "stem").withColumn("score", F.when(F.abs(z) >= LEAST_Z, delta).otherwise(0.0))
    words = words.filter((F.col("score") != 0) | F.col("stem_score").isNotNull()).select("word", "score")
    found = {r["stem"]: r["stem_score"] for r in stems.filter("stem_score IS NOT NULL").collect()}
    return {r["word"]: r["score"] for r in words.collect()}, found


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> ToxicModel:
    """A model from docs(doc_id, text) and labels(doc_id, toxic).

    It is fit on about `rows` rows of each class, chosen by a hash of doc_id, so the sample has a
    documented bound and is broadcast; four fifths give the token counts and the rest
    calibrates.  All of it runs on the executors; numbers alone come back.  A document with two labels
    counts as toxic if one says so; rows that share a doc_id share its label.  Null ids, labels and
    texts take no part.  Without labels of both classes, as in an empty table, nothing scores above 0.5."""
    spark = docs.sparkSession
    ship(spark)
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"] > 0): r["n"] for r in known.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return ToxicModel(level=-3.0)
    u = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("toxic")), F.lit(1_000_000)) / 1e6
    share = F.when(F.col("toxic") > 0, min(1.0, rows / sizes[1])).otherwise(min(1.0, rows / sizes[0]))
    chosen = known.filter(u < share).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5)))
    sample = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    sample = materialise(sample.select((F.col("toxic") > 0).cast("int").alias("toxic"), "part", "text").repartition(spark.sparkContext.defaultParallelism))
    raw = sample.filter("part > 0").select("toxic", F.monotonically_increasing_id().alias("row"), F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("raw"))
    word = F.regexp_replace("raw", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("word")
    # documents that hold a word, not its repeats: words cluster within documents
    counts = raw.select("row", "toxic", word).distinct().filter(F.col("word") != "").groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("toxic") == 0).alias("clean"))
    model = ToxicModel(*fit_words(counts.filter("toxic + clean > 1")))
    _calibrate(model, sample.filter("part = 0").select("toxic", "text"), sizes)
    return model


def _numbers(held_texts: DataFrame, model: ToxicModel, measure, schema: str) -> DataFrame:
    """Numbers for each held text, measured on the executors by measure(scorer, text)."""
    shared = held_texts.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        own = shared.value
        scorer = held(("toxicity", id(own)), lambda: ToxicScorer(own))
        for batch in batches:
            yield pd.DataFrame([(c, *measure(scorer, t)) for c, t in zip(batch["toxic"], batch["text"])], columns=[f.split(" ")[0] for f in schema.split(", ")])

    return held_texts.mapInPandas(each, schema)


def chance_passages(scorer: ToxicScorer, text: str) -> tuple[int, float, int]:
    """Number and summed scores of a text's segments, and its tokens."""
    tokens = scorer.tokens(text)
    found = maximal_segments(tokens)
    return len(found), float(sum(s[2] for s in found)), len(tokens)


def _calibrate(model: ToxicModel, held_texts: DataFrame, sizes: dict[int, int]) -> None:
    """Extreme-value constants from clean texts, then a logistic curve over the evidence.  Sums and one
    number a text (of a bounded number of texts) come to the driver."""
    clean = _numbers(held_texts.filter("toxic = 0"), model, chance_passages, "toxic int, n int, s double, tokens long")
    r = clean.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("tokens").alias("tokens")).first()
    n, total, length = r["n"] or 0, r["s"] or 0.0, r["tokens"] or 0
    # passages of a clean text: K n exp(-lambda s) of them score s or more; half a passage is added
    # to the count and one of score 1 to the sum, so that a sample without any still has a law
    model.rate = float(np.clip((n + 1) / (total + 1), 0.1, 1.0))
    model.scale = (n + 0.5) / max(length, 1)
    rows = _numbers(held_texts, model, lambda scorer, text: (scorer.passages(text)[1],), "toxic int, evidence double").toPandas()
    rows = rows.sort_values(["toxic", "evidence"])
    model.slope, model.level = logistic(rows["evidence"].to_numpy(), rows["toxic"].to_numpy().astype(float), sizes)


def logistic(evidence: np.ndarray, truth: np.ndarray, sizes: dict[int, int]) -> tuple[float, float]:
    """Slope and level of the curve that fits the truth best, each class weighing as in the whole table."""
    weight = np.where(truth > 0, sizes[1] / max(truth.sum(), 1), sizes[0] / max((1 - truth).sum(), 1))
    weight = weight / weight.sum() if len(weight) else weight
    x = np.clip(evidence, -1, 15)
    best = None
    for slope in np.geomspace(0.25, 4, 9):  # two bounded parameters: a grid can't diverge
        for level in np.linspace(-14, 4, 73):
            m = slope * x + level
            loss = float(np.sum(weight * (np.logaddexp(0, m) - truth * m))) + 1e-4 * (slope - 1) ** 2 + 1e-5 * level**2
            if best is None or loss < best[0]:
                best = loss, float(slope), float(level)
    return best[1:]


def score_toxicity(docs: DataFrame, model: ToxicModel, column: str = "__toxicity") -> DataFrame:
    """docs with a struct column (score, passages) from its column text.

    score: 0 to 1; passages: every significant passage as (first token, last token + 1, score).
    Null and empty texts score as a text without evidence; very long texts count whole.  A scan
    without a shuffle: equal rows get equal results, an empty table gives an empty one; a column named
    as the new one is replaced, all others pass."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<first:int,last:int,score:double>>")
    def rate(texts: pd.Series) -> pd.DataFrame:
        model = shared.value  # a scorer holds its model, so that the model's id stands for it alone
        scorer = held(("toxicity", id(model)), lambda: ToxicScorer(model))
        score, found = [], []
        for t in texts:
            strong, evidence = scorer.passages(t or "")
            score.append(scorer.probability(evidence))
            found.append([{"first": a, "last": b, "score": s} for a, b, s in strong])
        return pd.DataFrame({"score": score, "passages": found})

    return docs.withColumn(column, rate("text"))


def trainable(docs: DataFrame) -> DataFrame:
    """Rows whose labels the contract lets the model learn from."""
    return docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
