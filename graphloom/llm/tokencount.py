"""Token counts: lengths only, from Arrow batches balanced by bytes, long texts cut where no token can span."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, held, ship

#: Characters of texts, or of new pieces, that are taken at once.
BATCH_CHARS = 1 << 20
#: A space that starts a new piece.  In the vocabulary a word mark is only first in a piece or
#: in runs of marks, and nothing is done across words; so what stands before such a space and
#: what follows it are encoded apart with the same result.
CUT = re.compile("(?<=[^ ▁]) (?!\\Z)")


class PieceCounter:
    """Counts tokens of texts with a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = Recent(self._compute)

    def _compute(self, pieces: list[str]) -> list[int]:
        out, start, size = [], 0, 0
        for i, piece in enumerate(pieces, 1):
            size += len(piece)
            if size >= BATCH_CHARS or i == len(pieces):
                out += map(len, self.model.encode(pieces[start:i], num_threads=1))
                start, size = i, 0
        return out

    def count_all(self, texts: list[str]) -> list[int]:
        split = [CUT.split(t) if t else [] for t in texts]
        self.pieces.need(set().union(*split))
        get = self.pieces.__getitem__
        return [sum(map(get, s)) for s in split]

    def count(self, text: str) -> int:
        return self.count_all([text])[0]


def counter(path: str) -> PieceCounter:
    return held(("counter", path), lambda: PieceCounter(path))


def count_tokens(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs(doc_id, text).

    path: the sentencepiece model on every executor.  The whole text counts, special strings
    as the library takes them by default, nothing added.  Null or empty text: 0 and 0.
    A scan without a shuffle; only lengths leave Python."""
    ship(docs.sparkSession)

    @F.pandas_udf("long")
    def tokens(texts: pd.Series) -> pd.Series:
        out: list[int] = []
        part, size = [], 0
        for t in texts:
            part.append(t or "")
            size += len(t or "")
            if size >= BATCH_CHARS:
                out += counter(path).count_all(part)
                part, size = [], 0
        return pd.Series(out + counter(path).count_all(part), dtype="int64")

    rows = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), tokens("text").alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
