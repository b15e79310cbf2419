"""A bit map of hashed ids, of fixed size: which rows surely aren't in a set, decided where they are read.

Built by Spark's bitmap aggregates (partial maps are merged as they come, so no task holds more
than one) and looked up by expressions; no row leaves the JVM and neither side is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Bits of the map (1 MB). Of far more ids than bits it tells nothing, and what uses it must stay right then.
BITS = 23
_BLOCK = 15


def of(ids: DataFrame, bits: int = BITS) -> np.ndarray:
    """The map of the first column, a long that is a hash (its top bits are the place); nulls are ignored."""
    place = F.shiftrightunsigned(F.col(ids.columns[0]), 64 - bits)
    rows = ids.where(F.col(ids.columns[0]).isNotNull()).select(place.alias("p")).groupBy(F.shiftright("p", _BLOCK).alias("block"))
    out = np.zeros((1 << (bits - _BLOCK), 1 << (_BLOCK - 3)), np.uint8)
    for r in rows.agg(F.bitmap_construct_agg(F.col("p").bitwiseAND((1 << _BLOCK) - 1)).alias("map")).collect():  # at most 2 ** (bits - 15) rows of 4 kB
        out[r.block] = np.frombuffer(r.map, np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").astype(bool)


def holds(df: DataFrame, marks: np.ndarray, column: str = "cls") -> Column:
    """Whether a row's hash is marked in a map of a power of two of marks; for a filter on df."""
    bits = len(marks).bit_length() - 1
    words = np.packbits(marks, bitorder="little").view(np.int64)
    table = df.sparkSession.createDataFrame(pa.table({"map": pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(words))})).scalar()
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    return F.getbit(F.get(table, F.shiftrightunsigned(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1


def split(df: DataFrame, marks: np.ndarray, column: str = "cls", maybe: bool = True) -> DataFrame:
    """Rows whose hash may be in the set (maybe=True: all that are, and a few others) or surely isn't."""
    held = holds(df, marks, column)
    return df.where(held if maybe else ~held)
