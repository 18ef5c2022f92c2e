"""A Bloom filter of fixed size over long ids: it keeps most other rows out of a shuffle; an exact semi-join follows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MULT, map_arrow, mix64

#: Bits of the filter (2 MB). Beyond some ten million ids it lets ever more rows pass, and never loses one.
BITS = 1 << 24
HASHES = 3


def _positions(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64)
    return np.stack([mix64(x * MULT[k] + MULT[k + 1]) & np.uint64(BITS - 1) for k in range(HASHES)])


def _bits(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63))


def build(ids: DataFrame) -> np.ndarray:
    """The filter's words from a table of one long column; BITS / 64 rows at most go to the driver."""

    def run(batches):
        words = np.zeros(BITS // 64, np.uint64)
        for b in batches:
            for p in _positions(b.column(0).drop_null().to_numpy()):
                at, bit = _bits(p)
                np.bitwise_or.at(words, at, bit)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at].view(np.int64))], names=["at", "bits"])

    got = map_arrow(ids, run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    words = np.zeros(BITS // 64, np.uint64)
    words[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return words


def prefilter(df: DataFrame, id_col: str, words: np.ndarray) -> DataFrame:
    """The rows whose id may be in the filter; rows without an id go."""
    shared, at = df.sparkSession.sparkContext.broadcast(words), df.columns.index(id_col)

    def run(batches):
        for b in batches:
            ids = b.column(at)
            keep = np.asarray(ids.is_valid())
            values = ids.fill_null(0).to_numpy()
            for p in _positions(values):
                i, bit = _bits(p)
                keep &= (shared.value[i] & bit) != 0
            yield b.filter(pa.array(keep))

    return map_arrow(df, run, df.schema)
