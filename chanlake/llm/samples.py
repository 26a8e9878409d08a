"""Bounded samples of rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a sample may have, and characters that count of one text in it.
MOST_BYTES, MOST_CHARS = 64 << 20, 20_000


def sample(df: DataFrame, row_id: str, text: str, most: int, rows: int | None = None) -> list[str]:
    """The ``most`` non-null texts with the smallest hash of the row id; ``rows`` is their number if known.

    The same rows at every run. A first cut at twice the expected hash leaves about that many to sort, whatever the size of
    the table; where it leaves too few, all are sorted.
    """
    key = F.xxhash64(F.lit("sample"), df[row_id])
    x = df.where(df[text].isNotNull()).select(key.alias("h"), df[row_id].alias("i"), F.left(df[text].cast("string"), F.lit(MOST_CHARS)).alias("t"))
    n = x.count() if rows is None else rows
    some = x.where(F.col("h") < threshold(most, n)) if n > 2 * most else x
    got = some.orderBy("h", "i").limit(most).toArrow()["t"].to_pylist()
    if len(got) < min(most, n) and n > 2 * most:
        got = x.orderBy("h", "i").limit(most).toArrow()["t"].to_pylist()
    size = 0
    for k, t in enumerate(got):
        size += len(t)
        if size > MOST_BYTES:
            return got[:k]
    return got


def threshold(most: int, n: int) -> int:
    """The 64-bit hash below which about 1.5 times ``most`` of ``n`` rows lie."""
    return min((1 << 63) - 1, -(1 << 63) + (3 * most * (1 << 64)) // (2 * max(1, n)))
