"""Compressed-size entropy of texts: zlib at level 9 over the text with line ends made alike."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SMALL = 200


def measured(text: str | None) -> tuple[float, int, int]:
    """(ratio, compressed bytes, bytes) of a text that is compressed once: compressed over original bytes; 0 for the empty text; a short text above 0.5 is drawn
    toward 0.5 by its length."""
    raw = (text or "").replace("\r\n", "\n").encode()
    if not raw:
        return 0.0, 0, 0
    size = len(zlib.compress(raw, 9))
    ratio = size / len(raw)
    return (0.5 + (ratio - 0.5) * len(raw) / SMALL if len(raw) < SMALL and ratio > 0.5 else ratio), size, len(raw)


def entropy_ratio(text: str | None) -> float:
    return measured(text)[0]


def entropy(text: Column | str) -> Column:
    def ratios(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([entropy_ratio(x) for x in s], dtype=float)

    return F.pandas_udf(ratios, "double")(text)


#: Upper bounds of the ratio, and what a text below them is called; the last name is for all above, the first for the empty text.
BANDS = (
    (0.2, "extreme redundancy (possible boilerplate or repetitive data)"),
    (0.5, "low entropy (standard well-structured code)"),
    (0.8, "moderate entropy (complex or dense logic)"),
)
ABOVE, EMPTY = "high entropy (low redundancy; possible noise or obfuscation)", "empty"


def label(value: Column, size: Column | None = None) -> Column:
    """The band of a ratio; with the original size also that of the empty text."""
    out = F.when(size == 0, EMPTY) if size is not None else F.when(F.lit(False), EMPTY)
    for bound, name in BANDS:
        out = out.when(value < bound, name)
    return out.otherwise(ABOVE)


def detail(text: Column | str) -> Column:
    """A struct (ratio, compressed_size, original_size) of a text, sizes in bytes after line ends are made alike; zeros for the empty text."""

    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([measured(x) for x in s], columns=["ratio", "compressed_size", "original_size"])

    return F.pandas_udf(sizes, "ratio double, compressed_size long, original_size long")(text)


def blocks(text: Column, size: int) -> Column:
    """The text in chunks of ``size`` characters."""
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(1), n, F.lit(size))).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))


def block_variance(texts, key: str, text: str, size: int = 256):
    """(key, blocks, variance): the population variance of the blocks' entropies; 0 with fewer than two."""
    b = texts.select(key, F.explode_outer(blocks(F.col(text), size)).alias("b")).withColumn("e", entropy("b"))
    return b.groupBy(key).agg(F.count("b").alias("blocks"), F.when(F.count("b") < 2, 0.0).otherwise(F.var_pop(F.when(F.col("b").isNotNull(), F.col("e")))).alias("variance"))
