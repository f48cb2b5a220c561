"""Embedding whitening by tiled covariance.

Entries are put on a grid (floor(STEPS * c), whole numbers), and each distinct vector counts once. Those vectors are cut
into row-blocks of ROWS and, within each, into column blocks of TILE dimensions, which are written as a table: a block
holds the same rows whenever it is read. A pair of tiles of dimensions is a key: the column blocks of a row-block meet
(a join on the row-block), are centred with the exact means and multiplied, products of a task are added up where they
are made, and Spark sums them by tile pair and place. No task holds more than two column blocks and HELD tiles of
products, whatever the number of rows or dimensions; the driver gets the sums (as many as there are pairs of dimensions) and
decomposes them. Whitened rows are then one pass over all vectors with the components broadcast (dimensions x components).

The quality of the result is measured, not assumed: column blocks are projected, added up by row-block, and the
covariance of the whitened rows is held against the identity.

Defined results: vectors that are null, empty or hold null or non-finite entries take no part, nor do those of another
length than the most frequent one (of equally frequent lengths the longer); repeated rows and ids are whitened each, rows
without an id too; entries beyond a long's range are put at its end; a deviation that no long holds is null; along a component without
variance (one vector, fewer vectors than dimensions, a constant dimension) whitened is null and has no part in the identity
error, which is null if there is no other component; explained is null if nothing varies; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import ready_workers, stored

STEPS = 256
#: Rows of a row-block, dimensions of a tile, products of tiles that a task adds up before it passes them on.
ROWS, TILE, HELD = 512, 32, 256
_LONG = 1 << 63
_BLOCKS = "block long, tile int, n long, kind string, data binary, sums array<decimal(38,0)>"
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    n: int
    sums: list[int]  # of the grid values, by dimension
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # dimensions x components, unit columns
    trace: float
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])  # true division of ints is rounded once

    def live(self) -> np.ndarray:
        """Which components have variance beyond what rounding leaves."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps * 4

    def scaled(self, k: int | None = None) -> np.ndarray:
        """Columns that project centred rows on components and scale them; NaN without variance."""
        root = np.sqrt(np.where(self.live(), self.values, np.nan))
        return (self.components / root)[:, :k]


def usable(column: Column) -> Column:
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & (F.size(column) > 0), F.lit(False))


def gridded(vectors: DataFrame, id_column: str, column: str, steps: int = STEPS) -> DataFrame:
    """id and x (array of longs) of the vectors that take part."""
    kept = vectors.select(F.col(id_column).alias("id"), F.col(column).alias("v")).where(usable(F.col("v")))
    usual = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    kept = kept.where(F.size("v") == (usual.d if usual else 0))
    return kept.select("id", F.transform("v", lambda c: F.floor(c.cast("double") * steps)).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def column_blocks(x: DataFrame, rows_of_block: int = ROWS, width: int = TILE) -> DataFrame:
    """A row for each row-block of the distinct x and tile of dimensions: entries row by row in the narrowest type that
    holds them, and their sums. Stored, so that the column blocks of a row-block always hold the same rows."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rows = _matrix(batch.column("x"))
            for begin in range(0, len(rows), rows_of_block):
                part = rows[begin : begin + rows_of_block]
                low, high = int(part.min()), int(part.max())
                kind = next(k for k in ("<i2", "<i4", "<i8") if low >= np.iinfo(k).min and high <= np.iinfo(k).max)
                whole = part.astype(object) if kind == "<i8" else part
                sums = [Decimal(int(s)) for s in whole.sum(axis=0)]
                tiles = range(0, part.shape[1], width)
                yield pa.record_batch(
                    [
                        pa.array([number] * len(tiles), pa.int64()), pa.array(range(len(tiles)), pa.int32()), pa.array([len(part)] * len(tiles), pa.int64()), pa.array([kind] * len(tiles)),
                        pa.array([np.ascontiguousarray(part[:, t : t + width], kind).tobytes() for t in tiles], pa.binary()), pa.array([sums[t : t + width] for t in tiles], pa.list_(pa.decimal128(38, 0))),
                    ],
                    ["block", "tile", "n", "kind", "data", "sums"],
                )
                number += 1

    return stored(x.select("x").distinct().mapInArrow(cut, _BLOCKS), "column-blocks")


def _centred(row: dict, side: str, mean: np.ndarray, width: int) -> np.ndarray:
    own = mean[row[f"tile{side}"] * width : (row[f"tile{side}"] + 1) * width]
    return np.frombuffer(row[f"data{side}"], row[f"kind{side}"]).reshape(-1, len(own)).astype(np.float64) - own


def tile_sums(blocks: DataFrame, mean: np.ndarray, width: int = TILE, most: int = HELD) -> DataFrame:
    """Sums of products of centred entries by pair of tiles (a <= b) and place in it: tile_a, tile_b, pos, value."""
    left = blocks.select("block", F.col("tile").alias("tile_a"), F.col("kind").alias("kind_a"), F.col("data").alias("data_a"))
    right = blocks.select("block", F.col("tile").alias("tile_b"), F.col("kind").alias("kind_b"), F.col("data").alias("data_b"))
    pairs = left.join(right, "block").where("tile_a <= tile_b").drop("block")

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                key = row["tile_a"], row["tile_b"]
                if key not in held and len(held) == most:
                    yield _products(held)
                    held.clear()
                held[key] = held.get(key, 0.0) + _centred(row, "_a", mean, width).T @ _centred(row, "_b", mean, width)
        if held:
            yield _products(held)

    made = pairs.mapInArrow(multiply, "tile_a int, tile_b int, products array<double>")
    return made.select("tile_a", "tile_b", F.posexplode("products").alias("pos", "value")).groupBy("tile_a", "tile_b", "pos").agg(F.sum("value").alias("value"))


def _products(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), pa.array([v.ravel() for v in held.values()], pa.list_(pa.float64()))], ["tile_a", "tile_b", "products"])


def _assembled(sums: pa.Table, d: int, tile: int) -> np.ndarray:
    a, b, pos, value = (sums.column(c).to_numpy() for c in ("tile_a", "tile_b", "pos", "value"))
    width = np.minimum(tile, d - b.astype(int) * tile)
    i, j = a.astype(int) * tile + pos // width, b.astype(int) * tile + pos % width
    out = np.zeros((d, d))
    out[i, j] = value
    out[j, i] = value
    return out


def identity_error(blocks: DataFrame, found: Whitening, k: int | None = None, width: int = TILE) -> float | None:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    scaled, mean = found.scaled(k), found.mean
    scaled = scaled[:, ~np.isnan(scaled[0])]
    size = scaled.shape[1]
    if not size:
        return None

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            parts = [(_centred(r, "", mean, width) @ scaled[r["tile"] * width : (r["tile"] + 1) * width]).astype("<f8").tobytes() for r in rows]
            yield pa.record_batch([batch.column("block"), pa.array(parts, pa.binary())], ["block", "part"])

    def squares(table: pa.Table) -> pa.Table:
        rows = sum(np.frombuffer(p, "<f8") for p in table.column("part").to_pylist()).reshape(-1, size)
        return pa.table({"products": pa.array([(rows.T @ rows).ravel()], pa.list_(pa.float64()))})

    parts = blocks.select("block", "tile", "kind", "data").mapInArrow(project, "block long, part binary")
    made = parts.groupBy("block").applyInArrow(squares, "products array<double>")
    sums = made.select(F.posexplode("products").alias("pos", "value")).groupBy("pos").agg(F.sum("value").alias("value")).toArrow().sort_by("pos")
    return float(np.abs(sums.column("value").to_numpy().reshape(size, size) / found.n - np.eye(size)).max())


def fit(x: DataFrame, k: int | None = None, rows: int = ROWS, tile: int = TILE, held: int = HELD) -> Whitening | None:
    """x: arrays of longs of one length. None without rows. k: components that the identity error is measured on."""
    ready_workers(x.sparkSession)
    blocks = column_blocks(x, rows, tile)
    totals = blocks.select("tile", "n", F.posexplode("sums").alias("pos", "s")).groupBy("tile", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    totals = totals.orderBy("tile", "pos").collect()  # as many rows as dimensions
    if not totals:
        return None
    n, sums = totals[0].n, [int(r.s) for r in totals]
    found = Whitening(n, sums, np.zeros(0), np.zeros((0, 0)), 0.0)
    v = _assembled(tile_sums(blocks, found.mean, tile, held).toArrow(), len(sums), tile) / n
    values, vectors = np.linalg.eigh(v)
    vectors = vectors[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(sums))])  # the largest entry is positive
    found.values, found.components, found.trace = values[::-1], vectors * signs, float(np.trace(v))
    found.identity_error = identity_error(blocks, found, k, tile)
    return found


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    if most < _LONG and len(sums) * most * most < _LONG:
        return ((n * x - np.array(sums)) ** 2).sum(axis=1).tolist()
    found = (((n * x.astype(object)) - np.array(sums, object)) ** 2).sum(axis=1)
    return [int(s) if s < _LONG else None for s in found]


def transform(x: DataFrame, found: Whitening, k: int | None = None) -> DataFrame:
    """id, deviation and whitened (array of k doubles) of rows with id and x."""
    ready_workers(x.sparkSession)
    scaled, mean, n, sums = found.scaled(k), found.mean, found.n, found.sums
    dead = np.isnan(scaled[0])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = _matrix(batch.column("x"))
            out = (own - mean) @ np.where(dead, 0.0, scaled)
            white = pa.array(out.ravel(), mask=np.tile(dead, len(out)))
            offsets = pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32))
            yield pa.record_batch([batch.column("id"), pa.array(_deviations(own, n, sums), pa.int64()), pa.ListArray.from_arrays(offsets, white)], ["id", "deviation", "whitened"])

    return x.mapInArrow(rows, f"id {x.schema['id'].dataType.simpleString()}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int | None = 4, id_column: str = "vec_id", column: str = "embedding", **tiling: int) -> DataFrame:
    """A row for each usable vector and component (from 1, of the largest variance)."""
    x = gridded(vectors, id_column, column)
    found = fit(x, components, **tiling)
    if found is None:
        return vectors.sparkSession.createDataFrame([], _RESULT.replace("vec_id", id_column))
    explained = [float(e) / found.trace if found.trace > 0 else None for e in found.values]
    share = F.array(*[F.lit(e).cast("double") for e in explained])
    rows = transform(x, found, components).select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        F.col("id").alias(id_column), (F.col("at") + 1).cast("int").alias("component"), F.lit(found.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(found.identity_error).cast("double").alias("identity_error"),
    )
