"""Sets of hashes as one bit each, small enough for every task whatever the number of rows.

A filter says yes to everything in its set and, by chance, to some of the rest: what it lets through is
checked by whoever uses it. Its size grows with the rows up to 32 MB; beyond, more passes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

MOST_BITS = 28


def bits_for(rows: int) -> int:
    """Bits of a hash that are looked at: about one of 32 places is taken, until the filter has 2**28 places."""
    return int(np.clip(np.ceil(np.log2(32 * max(1, rows))), 16, MOST_BITS))


def place_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    def __init__(self, bits: int, table: np.ndarray):
        self.bits, self.table = bits, table

    def at(self, place: np.ndarray) -> np.ndarray:
        return (self.table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1

    def has(self, hashes: np.ndarray) -> np.ndarray:
        return self.at(place_of(hashes, self.bits))


def filter_from(places: DataFrame, bits: int) -> Filter:
    """The filter of a column of places. Blocks of 4 KB are put together by Spark; the driver gets 32 MB at most."""
    place = F.col(places.columns[0]) + 1  # Spark counts bits from 1
    blocks = places.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bitmap")
    )
    table = np.zeros(1 << bits >> 3, np.uint8)
    for r in blocks.take(max(1, 1 << bits >> 15)):
        own = table[(r["block"] - 1) << 12 : r["block"] << 12]
        own[:] = np.frombuffer(r["bitmap"], np.uint8)[: len(own)]
    return Filter(bits, table)
