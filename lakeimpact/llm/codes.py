"""Vector codes: each part of a vector becomes the number of the nearest entry of a codebook.

Nearest entries are found by slicing and intersecting bitmasks. Per dimension the entries are sorted by
coordinate, and a mask for each place says which entries come before it. A radius around a coordinate is a
range of places, the difference of two masks; ANDed over the dimensions they leave the entries of a box, and whatever lies
within the radius lies in that box. So an entry found no further away than the radius is the nearest. A first
radius is half the distance to the best of a few probes; what it does not settle is searched with the least
distance seen so far, which always does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import Scratch

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
AT_ONCE = 1 << 20  # numbers of one comparison of a block of vectors with all entries


class Slices:
    """The entries of one codebook (entries x dimensions, integers), ready to be searched."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        m, d = entries.shape
        self.order = np.argsort(entries, axis=0, kind="stable")
        self.ranked = np.take_along_axis(entries, self.order, axis=0)
        bits = np.zeros((d, m + 1, -(-m // 64)), np.uint64)
        for j in range(d):
            own = self.order[:, j]
            bits[j, np.arange(1, m + 1), own // 64] = np.uint64(1) << (own % 64).astype(np.uint64)
        self.before = np.bitwise_or.accumulate(bits, axis=1)  # place -> entries that come before it

    def inside(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Bitmasks (rows x words) of the entries within the radius in every dimension."""
        found = np.full((len(x), self.before.shape[2]), np.iinfo(np.uint64).max, np.uint64)
        for j, masks in enumerate(self.before):
            low = np.searchsorted(self.ranked[:, j], x[:, j] - radius, "left")
            high = np.searchsorted(self.ranked[:, j], x[:, j] + radius, "right")
            found &= masks[high] ^ masks[low]
        return found

    def _best(self, x: np.ndarray, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of each row's candidates, ties to the lowest, and its squared distance; -1 and the
        greatest number where there is none."""
        m = len(self.entries)
        bits = np.unpackbits(masks.view(np.uint8), axis=1, bitorder="little")[:, :m]
        row, entry = np.nonzero(bits)
        least = np.full(len(x), np.iinfo(np.int64).max)
        number = np.full(len(x), -1)
        if len(row):
            distance = ((x[row] - self.entries[entry]) ** 2).sum(axis=1)
            rows, starts, held = np.unique(row, return_index=True, return_counts=True)
            least[rows] = np.minimum.reduceat(distance, starts)
            tied = np.where(distance == np.repeat(least[rows], held), entry, m)
            number[rows] = np.minimum.reduceat(tied, starts)
        return number, least

    def _probed(self, x: np.ndarray) -> np.ndarray:
        """The least squared distance to the entries that come next to x in each dimension."""
        least = np.full(len(x), np.iinfo(np.int64).max)
        for j in range(x.shape[1]):
            place = np.minimum(np.searchsorted(self.ranked[:, j], x[:, j]), len(self.entries) - 1)
            np.minimum(least, ((x - self.entries[self.order[place, j]]) ** 2).sum(axis=1), out=least)
        return least

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each row of x and the squared distance to it."""
        m, d = self.entries.shape
        number, least = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        if not d:
            return number, least
        step = max(1, AT_ONCE // (m * d))
        for at in range(0, len(x), step):
            some = x[at : at + step]
            bound = self._probed(some)
            radius = _root(bound) // 2
            found, far = self._best(some, self.inside(some, radius))
            open_ = np.flatnonzero((found < 0) | (far > radius**2))
            if len(open_):
                rest = some[open_]
                radius = _root(np.minimum(far[open_], bound[open_]))
                found[open_], far[open_] = self._best(rest, self.inside(rest, radius))
            number[at : at + step], least[at : at + step] = found, far
        return number, least


def _root(squares: np.ndarray) -> np.ndarray:
    """A whole number that is no less than the square root, and above it by one at most."""
    return np.floor(np.sqrt(squares.astype(np.float64))).astype(np.int64) + 1


def largest(width: int) -> int:
    """The largest component that parts of ``width`` components may have, so that their squared distances
    stay below 2**62."""
    return isqrt((1 << 62) // max(1, width)) // 2


def whole_vectors(vectors: DataFrame, vec_id: str, embedding: str, label: str, parts: int, scale: int) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of the vectors without null or non-finite components. Vectors
    are filled up with zeros to one length that ``parts`` divides."""
    each = F.col(embedding).cast("array<double>")
    finite = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(embedding).isNotNull() & finite).select(
        F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), each.alias("x")
    )
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    width = -(-longest // parts)
    most = largest(width)

    def number(x: Column) -> Column:
        return F.when(F.abs(x * scale) < most, F.floor(x * scale)).otherwise(
            F.raise_error(F.lit(f"a component times {scale} is not below {most}")).cast("bigint")
        )

    zeros = F.array_repeat(F.lit(0).cast("bigint"), F.lit(parts * width) - F.size("x"))
    return rows.select("vec_id", "label", F.concat(F.transform("x", number), zeros).alias("v"))


def _matrix(column: pa.Array, parts: int) -> np.ndarray:
    """parts x rows x components of a column of lists of one length."""
    rows = len(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(rows, parts, -1).swapaxes(0, 1)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """parts x entries x components, from the rows (vec_id, v) of :func:`whole_vectors`.

    Entries start as the parts of the smallest ids (nulls last, rows that repeat an id in order of their
    components) and move to the rounded-down mean of what is nearest to them, ``rounds`` times. Only the
    codebooks and their sums pass through the driver, whose size the parameters fix.
    """
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").take(entries)
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).swapaxes(0, 1).copy()
    width = books.shape[2]
    if not width:
        return books

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        held = np.zeros(books.shape[:2], np.int64)
        total = np.zeros(books.shape, np.int64)
        for batch in batches:
            for p, x in enumerate(_matrix(batch.column(0), parts)):
                number, _ = slices[p].nearest(x)
                held[p] += np.bincount(number, minlength=books.shape[1])
                np.add.at(total[p], number, x)
        part, entry = np.nonzero(held)
        sums_of = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel(), pa.int64()))
        columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(held[part, entry], pa.int64()), sums_of]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "held", "total"])

    for _ in range(rounds):
        found = rows.select("v").mapInArrow(sums, "part int, entry int, held bigint, total array<bigint>")
        found = found.select("part", "entry", "held", F.posexplode("total").alias("place", "total"))
        moved = found.groupBy("part", "entry", "place").agg(F.sum("held").alias("held"), F.sum("total").alias("total"))
        for r in moved.take(books.size):
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["held"]
    return books


def encode(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of rows (vec_id, label, v) by given codebooks."""
    parts = len(books)
    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in ("vec_id", "label")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(book) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [s.nearest(x) for s, x in zip(slices, _matrix(batch.column(2), parts))]
            numbers = np.stack([number for number, _ in found], axis=1).astype(np.uint8)
            code = [bytes(n).hex() for n in numbers]
            error = sum(least for _, least in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())],
                names=["vec_id", "label", "code", "error"],
            )

    return rows.select("vec_id", "label", "v").mapInArrow(run, f"{', '.join(kinds)}, code string, error bigint")


def compress(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
) -> DataFrame:
    """One row per vector without null or non-finite components: vec_id, label, code, error, label_error,
    codebooks_sha256.

    ``code`` has two hexadecimal digits per part, ``error`` is the squared distance to the entries
    summed over the parts, ``label_error`` its sum over the rows of the same label (nulls are one). Null vectors and
    vectors with a null or non-finite component give no row; null ids come last when entries are chosen;
    rows that repeat are rows of their own. Vectors of different lengths are filled up with zeros. At most 256 entries.
    A component whose square could leave 64 bits (at 16 components a part: 2**28 or more after scaling) fails the
    job instead of giving a wrong distance. No vectors give no rows; other columns are ignored.
    """
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits: 256 entries at most")
    work = Scratch(vectors.sparkSession, "codes")
    rows = work.cut(whole_vectors(vectors, vec_id, embedding, label, parts, scale), "rows")
    books = codebooks(rows, parts, entries, rounds)
    coded = work.cut(encode(rows, books), "coded")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    # Both sides come from tables, so a label of very many rows is split at run time.
    sums = work.cut(sums, "sums")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "label", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")
    )
