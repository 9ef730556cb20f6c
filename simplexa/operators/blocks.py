"""Every block of points against every block: points packed many to a row, one task for each pair of blocks.

A side has BLOCKS blocks at most until one outgrows BLOCK_ROWS, so what is shuffled grows with
the points and a task holds two blocks. What a pair of blocks yields for its left points leaves
as slices of a few thousand points, which one task each merges over all right blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks a side, where these hold from LEAST_ROWS to BLOCK_ROWS points and up to BLOCK_VALUES coordinates.
BLOCKS = 12
LEAST_ROWS, BLOCK_ROWS, BLOCK_VALUES = 2048, 65536, 1 << 22
SLICE_ROWS = 4096
PACKED, DEALT = "block int, size int, parts array<binary>", "task int, size int, parts array<binary>"
Side = dict[str, np.ndarray]


def count(points: DataFrame, block_rows: int | None = None) -> tuple[int, int]:
    """(blocks, points) of (id, features)."""
    rows, width = points.agg(F.count("features"), F.max(F.size("features"))).first()
    if block_rows is None:
        block_rows = max(math.ceil(rows / BLOCKS), LEAST_ROWS)
        block_rows = max(1, min(block_rows, BLOCK_ROWS, BLOCK_VALUES // max(1, width or 1)))
    return max(1, math.ceil(rows / block_rows)), rows


def to_bytes(a: np.ndarray) -> bytes:
    """An array of one or two dimensions; doubles that are single-precision numbers take half the bytes."""
    if a.dtype == np.float64:
        with np.errstate(over="ignore"):
            short = a.astype(np.float32)
        a = short if np.array_equal(short, a) else a
    return f"{a.dtype.str[1:]}{a.ndim}".ljust(8).encode() + np.ascontiguousarray(a).tobytes()


def from_bytes(data: bytes, size: int) -> np.ndarray:
    a = np.frombuffer(data, data[:2].decode(), offset=8)
    a = a.astype(np.float64) if a.dtype == np.float32 else a
    return a.reshape(size, -1) if data[2:3] == b"2" else a


def matrix(column: pa.Array) -> np.ndarray:
    """Numbers, or arrays of numbers of one length, of an Arrow column."""
    if pa.types.is_list(column.type):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((h >> np.uint64(33)) % np.uint64(blocks)).astype(np.int32)


def _row(number: int, size: int, arrays: list[np.ndarray], name: str) -> pa.RecordBatch:
    parts = pa.array([[to_bytes(a) for a in arrays]], pa.list_(pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([size], pa.int32()), parts], [name, "size", "parts"])


def packed(points: DataFrame, blocks: int) -> DataFrame:
    """(block, size, parts) of (id, ...), all columns numbers or arrays of numbers of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [matrix(c) for c in b.columns]
            block = _block(columns[0], blocks)
            order = np.argsort(block, kind="stable")
            ends = np.searchsorted(block[order], np.arange(blocks + 1))
            for n in range(blocks):
                at = order[ends[n] : ends[n + 1]]
                if len(at):
                    yield _row(n, len(at), [c[at] for c in columns], "block")

    return points.mapInArrow(run, PACKED)


def _gathered(batches: Iterator[pa.RecordBatch], names: Callable[[int], list[str]]) -> dict[int, Side]:
    """What lies in the rows of one partition, by task; in the order of the ids."""
    held: dict[int, list[list[np.ndarray]]] = {}
    for b in batches:
        for task, size, parts in zip(b.column("task").to_pylist(), b.column("size").to_pylist(), b.column("parts"), strict=True):
            held.setdefault(task, []).append([from_bytes(x.as_buffer().to_pybytes(), size) for x in parts])
    found = {}
    for task in list(held):
        columns = [np.concatenate(c) for c in zip(*held.pop(task), strict=True)]
        order = np.argsort(columns[0], kind="stable")
        found[task] = dict(zip(names(task), (c[order] for c in columns), strict=True))
    return found


def met(left: DataFrame, right: DataFrame, a: int, b: int, kernel: Callable[[int, Side, Side], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``kernel`` yields for the columns of each of ``a`` left and each of ``b`` right blocks; its number is left * b + right."""
    names = (left.columns, right.columns)

    def dealt(side: DataFrame, blocks: int, other: int, base: int, step: int, own: int) -> DataFrame:
        each = packed(side, blocks).select("block", "size", "parts", F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias("n"))
        return each.select((F.col("block") * base + F.col("n") * step).alias("task"), "size", "parts", F.lit(own).alias("own"))

    def against(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: tuple[list, list] = ([], [])
        for batch in batches:
            own = batch.column("own").to_numpy()
            for n in (0, 1):
                sides[n].append(batch.filter(pa.array(own == n)))
        lefts, rights = (_gathered(iter(side), lambda _, n=n: names[n]) for n, side in enumerate(sides))
        for task in sorted(set(lefts) & set(rights)):
            yield from kernel(task, lefts.pop(task), rights.pop(task))

    both = dealt(left, a, b, b, 1, 0).unionByName(dealt(right, b, a, 1, b, 1))
    return both.repartitionById(a * b, "task").mapInArrow(against, schema)


def crossed(left: DataFrame, right: DataFrame, a: int, b: int, rows: int, kernel: Callable[[Side, Side], tuple[Side, Side]], merge: Callable[[np.ndarray, list[Side]], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """What ``merge`` makes of the results of ``kernel`` for each slice of left points; points without features go.

    ``a`` and ``b`` are the blocks of both sides, ``rows`` is about how many left points there are. ``kernel`` gets both
    blocks' columns and returns arrays with a row for each left point, and whole arrays; ``merge`` gets the ids of a
    slice and these arrays of every right block, and returns columns of the result.
    """
    slices = max(1, math.ceil(rows / a / SLICE_ROWS))

    def sliced(task: int, x: Side, y: Side) -> Iterator[pa.RecordBatch]:
        each, whole = kernel(x, y)
        step = math.ceil(len(x["id"]) / slices)
        for s, at in enumerate(range(0, len(x["id"]), step)):
            part = slice(at, at + step)
            yield _row(task // b * slices + s, len(x["id"][part]), [x["id"][part], *(v[part] for v in each.values()), *(np.asarray(v) for v in whole.values())], "task")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for task, size, parts in zip(batch.column("task").to_pylist(), batch.column("size").to_pylist(), batch.column("parts"), strict=True):
                held.setdefault(task, []).append([from_bytes(x.as_buffer().to_pybytes(), size) for x in parts])
        for task in sorted(held):
            found = held.pop(task)
            made = merge(found[0][0], [dict(enumerate(f[1:])) for f in found])
            size = len(next(iter(made.values())))
            for at in range(0, size, 1 << 15):
                yield pa.RecordBatch.from_pydict({k: v[at : at + (1 << 15)] for k, v in made.items()})

    near = met(*(side.where("features is not null") for side in (left, right)), a, b, sliced, DEALT)
    return near.repartitionById(a * slices, "task").mapInArrow(merged, schema)
