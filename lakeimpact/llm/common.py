"""What the operators share: settings, table access, word hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import apply_settings

# A batch that goes to Python is limited by rows and bytes, as texts differ in length
# by orders of magnitude.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession) -> SparkSession:
    apply_settings(spark)
    for key, value in BATCHES.items():
        spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str) -> Column:
    """The bytes of a text, null as empty; bytes reach Python without a conversion."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; a null id gives null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def words(text: bytes) -> list[bytes]:
    """Words as WORDS finds them: bytes.split() cuts at exactly these six bytes."""
    return text.split()


def word_hashes(found: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(33))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """One 64-bit hash per k consecutive words, in order; none if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= _STEP
        out += hashes[j : n + j]
    return mix(out)


# What a Python worker holds from task to task: by its holder, how it is let go.
_HELD: dict[str, Callable[[], None]] = {}


def hold_between_tasks(holder: str, let_go: Callable[[], None]) -> None:
    """Say that ``holder`` keeps something in this worker until another holder's function begins here."""
    _HELD[holder] = let_go


def give_back_memory(holder: str = "") -> None:
    """Let go what others than ``holder`` keep in this Python worker, and return what is free to the system.

    Workers live on from stage to stage, idle ones beside tasks that need none, and the allocators keep freed memory. For
    functions that are about to need much of it, and the end of those that did; where the C library has no such call, only Arrow's share is returned.
    """
    for other in _HELD.keys() - {holder}:
        _HELD.pop(other)()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def wire(a: np.ndarray) -> bytes:
    return a.tobytes()
