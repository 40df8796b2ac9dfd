"""Keys to order by: by code point, which the checks' SQL shares, or as a locale's dictionary would."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import NUL

#: How text is ordered: `binary` by code point, `locale` by the root collation (punctuation, digits, letters; accents,
#: then lower before upper case, only where letters are alike).
MODES = ("binary", "locale")


def order_key(*columns: Column | str, mode: str = "binary") -> list[Column]:
    """What to sort by so that rows come in the order of columns joined by NUL; null is empty.

    In a locale NUL weighs nothing, so joined keys compare as one text; texts that it takes for equal are told apart
    by code point."""
    if mode not in MODES:
        raise ValueError(f"no order: {mode}")
    joined = F.concat_ws(NUL, *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in columns])
    return [joined] if mode == "binary" else [F.collate(joined, "UNICODE"), joined]


def edge_order(edges: DataFrame, mode: str = "binary") -> list[Column]:
    """Order of edges: by id where they have one, else by their ends, kind and provenance."""
    parts = [c for c in ("src", "dst", "kind", "provenance") if c in edges.columns]
    joined = F.concat_ws(NUL, *[F.coalesce(F.col(c), F.lit("")) for c in parts])
    return order_key(F.coalesce(F.col("id"), joined) if "id" in edges.columns else joined, mode=mode)
