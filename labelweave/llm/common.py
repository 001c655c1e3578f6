"""Pieces that the training-data operators share: reading tables, cutting lineage, slicing Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import sys
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.shared import Scratch, shared_dir

__all__ = ["Scratch", "held", "ragged", "shared_dir", "slices", "small", "table", "tokenizer_path"]
T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file: $TOKENIZER_DIR if set, else the installed package's folder."""
    if folder := os.environ.get("TOKENIZER_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


_held: dict[str, object] = {}


_trim: Callable[[int], int] | None = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return what this process has freed to the system; allocators keep it otherwise, and workers are reused."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def held(name: str, make: Callable[[], T]) -> T:
    """What `make` gives, kept from task to task in this Python worker for one operator at a time.

    When another operator asks for its own, the former's memory is let go, so a reused worker never holds
    the remembered words of several stages. Every task that asks gives back what earlier tasks have freed.
    """
    if name not in _held:
        _held.clear()
    gc.collect()
    give_back()
    if name not in _held:
        _held[name] = make()
    return _held[name]


#: Rows of a few numbers that are sent to all executors at once, at most.
SMALL_ROWS = 200_000


def small(saved: DataFrame) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most SMALL_ROWS of them; a larger one is left to be shuffled."""
    return F.broadcast(saved) if saved.count() <= SMALL_ROWS else saved


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have about `most` bytes; a longer text stands alone, whole. What the work on a piece has freed goes back to the system."""
    if not batch.num_rows:
        return
    length = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start, done = np.cumsum(length, dtype=np.int64), 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        give_back()
        start, done = stop, int(ends[stop - 1])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)
