"""Embedding whitening from a tiled covariance.

Entries become whole numbers (`floor(scale * c)`), so counts, sums and deviations are exact. The covariance is made of
tiles, pairs of column blocks: tasks cut their rows into row blocks and every row block into column blocks, which are
shuffled by row block; there the blocks are centred by the exact means and the tile pairs multiplied; entries of tiles are summed by
position with partial sums in each task. What reaches the driver is one matrix of dimensions by dimensions, whatever the number of rows; it
is assembled and decomposed there, and all rows are projected by the same components. The covariance of the projected rows is then measured
the same way and compared with the identity.

Defined results: rows whose vector is null or empty, or holds a null or non-finite entry, or one so large that `scale` times
it leaves 2^52, are dropped; so are vectors of another length than the most frequent one (ties: the longest), as a covariance needs one length.
Components without variance (an eigenvalue below the rounding of the largest) can't be whitened and are left out, so equal vectors alone, one vector or
an empty table give an empty result. Repeated rows, null and repeated ids are rows of their own. Only the named columns are read, so none can clash.
Ties between eigenvalues go as the decomposition returns them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Entries beyond this aren't whole numbers that doubles tell apart.
LARGEST = 1 << 52
#: Columns of a block, and entries of a row block (rows times dimensions).
BLOCK = 32
ROW_BLOCK = 1 << 18


@dataclass(frozen=True)
class Whitening:
    """n rows, exact sums of each dimension, eigenvalues in falling order, components as columns, trace."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        """Centred vectors times this are whitened."""
        return self.components / np.sqrt(self.values)


def whole_numbers(vectors: pa.Array, scale: int = SCALE, shift: int = SHIFT) -> np.ndarray:
    """Rows of equal length as whole numbers; none is null."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(scale * flat).astype(np.int64) + shift).reshape(len(vectors), -1)


def usable(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """vec_id and vector, as doubles, of the rows that take part."""
    own = df.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    fits = F.forall("vector", lambda c: F.coalesce(F.abs(c) * scale < LARGEST, F.lit(False)))  # null, NaN and infinity aren't below
    own = own.filter((F.size("vector") > 0) & fits)
    length = own.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return own.filter(F.size("vector") == (length[0]["d"] if length else 0))


def exact_sums(rows: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> tuple[int, np.ndarray]:
    """How many rows, and the sum of each dimension as exact whole numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(batch.column("vector"), scale, shift)
                n, sums = n + len(x), x.sum(axis=0) if sums is None else sums + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(np.full(len(sums), n)), pa.array(sums)], names=["dim", "n", "total"])

    found = rows.select("vector").mapInArrow(add, "dim long, n long, total long").groupBy("dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    sums = np.array([int(r["total"]) for r in sorted(found, key=lambda r: r["dim"])], dtype=object)
    return (found[0]["n"] if found else 0), sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n: whole parts of the means are taken off exactly, then the rest."""
    whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    rest = np.array([(int(s) % n) / n for s in sums])
    return (x - whole) - rest


def column_blocks(rows: DataFrame, block: int = BLOCK, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """row_block, block, data: row blocks cut by columns, as the narrowest whole numbers that hold them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole_numbers(batch.column("vector"), scale, 0)
            step, out = max(1, ROW_BLOCK // x.shape[1]), []
            for first in range(0, len(x), step):
                for j in range(0, x.shape[1], block):
                    part = x[first : first + step, j : j + block]
                    size = next(b for b in (1, 2, 4, 8) if -(1 << (8 * b - 1)) <= part.min() and part.max() < 1 << (8 * b - 1))
                    out.append((number, j // block, part.shape[1], size, part.astype(f"i{size}").tobytes()))
                number += 1
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *[pa.array(columns[k], pa.int32()) for k in (1, 2, 3)], pa.array(columns[4], pa.binary())], names=["row_block", "block", "width", "bytes", "data"])

    return rows.select("vector").mapInArrow(cut, "row_block long, block int, width int, bytes int, data binary")


def covariance(blocks: DataFrame, n: int, sums: np.ndarray, block: int = BLOCK, shift: int = SHIFT) -> np.ndarray:
    """The covariance, divisor n, from column blocks; tiles above the diagonal mirror those below."""
    d = len(sums)
    own = np.array([int(s) - n * shift for s in sums], dtype=object)
    schema = T._parse_datatype_string("a int, b int, tile array<double>")

    def multiply(table: pa.Table) -> pa.Table:
        parts = {}
        for j, width, size, data in zip(*(table.column(c).to_pylist() for c in ("block", "width", "bytes", "data")), strict=True):
            x = np.frombuffer(data, dtype=f"i{size}").reshape(-1, width).astype(np.int64)
            parts[j] = centred(x, n, own[j * block : j * block + width])
        out = [(i, j, (parts[i].T @ parts[j]).ravel()) for i in parts for j in parts if i <= j]
        return pa.table([pa.array([t[0] for t in out], pa.int32()), pa.array([t[1] for t in out], pa.int32()), pa.array([t[2] for t in out], pa.list_(pa.float64()))], schema=pa.schema([("a", pa.int32()), ("b", pa.int32()), ("tile", pa.list_(pa.float64()))]))

    tiles = blocks.groupBy("row_block").applyInArrow(multiply, schema)
    # a task sums the tiles that it makes before anything is shuffled
    entries = tiles.select("a", "b", F.posexplode("tile").alias("at", "x")).groupBy("a", "b", "at").agg(F.sum("x").alias("x")).toArrow()
    v = np.zeros((d, d))
    a, b, at, x = (entries.column(c).to_numpy().astype(kind) for c, kind in (("a", int), ("b", int), ("at", int), ("x", float)))
    width = np.minimum(block, d - b * block)
    row, col = a * block + at // width, b * block + at % width
    v[row, col] = v[col, row] = x / n
    return v


def decompose(n: int, sums: np.ndarray, v: np.ndarray, components: int = COMPONENTS) -> Whitening:
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = min(components, int((values > values[0] * len(values) * np.finfo(float).eps).sum()) if values[0] > 0 else 0)
    return Whitening(n, sums, values[:kept].copy(), np.ascontiguousarray(vectors[:, :kept]), float(np.trace(v)))


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """Whitening of usable rows."""
    n, sums = exact_sums(rows)
    return decompose(n, sums, covariance(column_blocks(rows), n, sums) if n else np.zeros((0, 0)), components)


def identity_error(rows: DataFrame, found: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, over all rows."""
    k = len(found.values)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k + 1, k))
        for batch in batches:
            if batch.num_rows:
                y = centred(whole_numbers(batch.column("vector")), found.n, found.sums) @ found.matrix
                sums += np.vstack([y.sum(axis=0), y.T @ y])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], names=["at", "x"])

    got = rows.select("vector").mapInArrow(add, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()
    sums = np.zeros((k + 1) * k)
    for r in got:
        sums[r["at"]] = r["x"] / found.n
    mean, square = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(square - np.outer(mean, mean) - np.eye(k)).max()) if k else 0.0


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Of each row the sum over dimensions of (n * x - sum)^2, exact; one that leaves 64 bits is an error."""
    whole = np.array([int(s) // n for s in sums], dtype=np.int64)
    rest = np.array([int(s) % n for s in sums], dtype=object)
    low = x - whole
    most = n * (int(np.abs(low).max(initial=0)) + 1)
    if most * most * len(sums) < 1 << 63:
        far = n * low - rest.astype(np.int64)
        return (far * far).sum(axis=1)
    far = n * low.astype(object) - rest
    out = (far * far).sum(axis=1)
    if max(out, default=0) >= 1 << 63:
        raise OverflowError("a deviation doesn't fit into 64 bits")
    return out.astype(np.int64)


def project(rows: DataFrame, found: Whitening, error: float) -> DataFrame:
    """A row for each usable row and component."""
    k = len(found.values)
    kind = rows.schema["vec_id"].dataType
    schema = T.StructType([T.StructField("vec_id", kind), *T._parse_datatype_string("component int, n long, deviation long, whitened double, explained double, identity_error double").fields])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = found.matrix
        for batch in batches:
            for first in range(0, batch.num_rows, 1024) if k else ():
                part = batch.slice(first, 1024)
                x = whole_numbers(part.column("vector"))
                far = deviations(x, found.n, found.sums)
                y = centred(x, found.n, found.sums) @ matrix
                m = len(x)
                columns = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, found.n)),
                    pa.array(np.repeat(far, k)),
                    pa.array(y.ravel()),
                    pa.array(np.tile(found.values / found.trace, m)),
                    pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(apply, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of all usable rows of df."""
    rows = usable(df, id_col, vector_col)
    found = fit(rows, components)
    return project(rows, found, identity_error(rows, found))
