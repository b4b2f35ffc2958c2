"""What the training-data operators share: the shared folder, written intermediate tables and joins that leave wide rows in place."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veraframe.sources.shared import materialise, new_path, shared_dir

__all__ = ["BLANKS", "BLANK_CLASS", "CELLS", "WORD_CLASS", "fresh", "give_back", "keep_rows", "materialise", "new_path", "same", "shared_dir", "small_batches", "told_apart"]

#: White space of the text contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"

#: Number of hash cells by which rows that may be met by a join are told from those that can't be. A table of cells is
#: the only thing that these operators broadcast whose size depends on the input, and this is the most rows it has.
CELLS = 1 << 19


def same(left: DataFrame, right: DataFrame, columns: dict[str, str]) -> Column:
    """Null-safe equality of ``left``'s columns (keys) with ``right``'s (values)."""
    out = F.lit(True)
    for a, b in columns.items():
        out = out & left[a].eqNullSafe(right[b])
    return out


def cell_of(*columns: str | Column) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(CELLS)).cast("int")


def told_apart(rows: DataFrame, some: DataFrame, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(rows that can have their key in ``some``, rows that can't), by a table of at most ``CELLS`` cells.

    ``some`` is a narrow written table whose columns are the values of ``columns``; the keys name those of ``rows``. The
    rows of the second part stay where they are. The more of the input ``some`` holds, the more rows are in the first
    part; beyond about ``CELLS`` keys these are all rows, and the plan is that of a plain shuffled join.
    """
    cell = fresh(rows, "cell")
    cells = F.broadcast(materialise(some.select(cell_of(*columns.values()).alias(cell)).distinct(), "cells"))
    placed = rows.withColumn(cell, cell_of(*columns))
    return placed.join(cells, cell, "left_semi").drop(cell), placed.join(cells, cell, "left_anti").drop(cell)


def keep_rows(rows: DataFrame, keep: DataFrame, drop: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows of ``rows`` whose key is in ``keep``; ``drop`` holds the keys of all other rows. Both are narrow written tables.

    Rows whose cell has no key of ``drop`` are kept where they are. All others are shuffled and joined by the key
    (null-safe), at any size by the same plan.
    """
    mixed, calm = told_apart(rows, drop, columns)
    return calm.unionByName(mixed.join(keep.hint("merge"), same(mixed, keep, columns), "left_semi"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name beginning with ``name`` that ``df`` does not have (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(batches: Iterator[pa.RecordBatch], column: int, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in Arrow batches of about ``most`` bytes of text or binary in ``column``; a longer row stays whole."""
    for b in batches:
        part = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)) // most
        starts = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield b.slice(lo, hi - lo)
    give_back()


def give_back() -> None:
    """Return unused memory to the system, so that an idle worker keeps nothing for the next task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)
