"""A filter of bounded size that knows which 64-bit keys may belong to a set."""

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gableframe.llm.text import mix

# The filter has 4 MB whatever the set; a set that fills it lets more strangers through, never fewer members.
BITS = 1 << 25
PROBES = 2


def _places(keys: np.ndarray) -> list[np.ndarray]:
    mixed = mix(keys)
    step = (mixed >> np.uint64(32)) | np.uint64(1)
    return [(mixed + np.uint64(i) * step) & np.uint64(BITS - 1) for i in range(PROBES)]


def may_hold(filled: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Per key (uint64) whether it may be in the set; true for all that are."""
    found = np.ones(len(keys), bool)
    for place in _places(keys):
        found &= (filled[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def filter_of(keys: DataFrame) -> np.ndarray:
    """The filter for a table with one long column; nulls are left out.

    Tasks set bits, words of 64 bits are united in Spark, and the driver gets at most BITS / 64 of them.
    """
    name = keys.columns[0]

    def run(batches):
        import pyarrow as pa

        filled = np.zeros(BITS // 64, np.uint64)
        for batch in batches:
            own = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for place in _places(own):
                np.bitwise_or.at(filled, place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(filled)
        for a in range(0, len(at), 1 << 16):
            part = at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(filled[part].view(np.int64))], ["at", "bits"])

    words = keys.select(F.col(f"`{name}`").cast("long").alias("key")).mapInArrow(run, "at long, bits long")
    table = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    filled = np.zeros(BITS // 64, np.uint64)
    filled[table["at"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return filled


def may_be_in(key: Column, filled: Broadcast) -> Column:
    """Condition on a long column; a null key is in no set."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        known = keys.notna()
        own = keys[known].astype(np.int64).to_numpy().view(np.uint64)
        out = np.zeros(len(keys), bool)
        out[known.to_numpy()] = may_hold(filled.value, own)
        return pd.Series(out)

    return test(F.coalesce(key, F.lit(0))) & key.isNotNull()
