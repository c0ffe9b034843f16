"""Words and Arrow batches, as several operators need them inside tasks."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Python's bytes.split() without an argument splits at exactly these bytes.
SPACES = b" \t\n\r\x0b\x0c"
WORD = r"[^\x20\x09-\x0D]+"
ROWS_AT_ONCE = 64


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that operators read, as doc_id (long) and body (UTF-8 bytes)."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("body")
    )


def word_count(text: Column) -> Column:
    """Words of a text; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def bodies(batch: pa.RecordBatch, name: str = "body") -> Iterator[bytes | None]:
    """The values of a column, of which only a few are Python objects at a time."""
    column = batch.column(name)
    for at in range(0, len(column), ROWS_AT_ONCE):
        yield from column.slice(at, ROWS_AT_ONCE).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every input bit affects every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    factors = np.full(n, base % 2**64, np.uint64)
    factors[:1] = 1
    return np.multiply.accumulate(factors)
