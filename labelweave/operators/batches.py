"""Packed rows as arrays within tasks: all cells of a batch side by side, `size` cells for each row."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lists(batch: pa.RecordBatch, *names: str) -> tuple[np.ndarray, ...]:
    """(size, cells of the first column, of the second, ...): the columns are lists of equal lengths."""
    columns = [batch.column(x) for x in names]
    return np.diff(columns[0].offsets.to_numpy()), *(c.flatten().to_numpy(zero_copy_only=False) for c in columns)


def as_arrays(*fields: str) -> list[Column]:
    """Columns label_id, eta, ... of packed rows, each an array over the cells."""
    array = lambda x, kind: F.transform("cells", lambda c: c[x].cast(kind)).alias(x)
    return [array(x, "bigint" if x == "label_id" else "double") for x in fields]


def placed(names: np.ndarray, size: np.ndarray, label: np.ndarray, *cells: np.ndarray) -> tuple[np.ndarray, ...]:
    """(size, at, cells, ...): the labels' places in names; cells of other labels are left out."""
    at = np.minimum(np.searchsorted(names, label), max(0, len(names) - 1))
    known = names[at] == label if len(names) else np.zeros(len(label), bool)
    if known.all():
        return size, at, *cells
    row = np.repeat(np.arange(len(size)), size)[known]
    return np.bincount(row, minlength=len(size)), at[known], *(c[known] for c in cells)


def as_lists(size: np.ndarray, cells: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(cells))


def squeezed(*columns: np.ndarray | pa.Array) -> bytes:
    """Columns as compressed bytes, for `unsqueezed`: numbers of which few are different are stored as these and codes."""

    def coded(x: np.ndarray) -> tuple[np.ndarray, ...]:
        if isinstance(x, np.ndarray) and len(x) > 64:
            found = pa.array(x).dictionary_encode()
            kinds = len(found.dictionary)
            if kinds <= 1 << 16 and 8 * kinds + 2 * len(x) < x.nbytes:
                return found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy().astype(np.uint8 if kinds <= 256 else np.uint16)
        return (x,)

    data = pickle.dumps([coded(x) for x in columns], protocol=5)
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> list[np.ndarray | pa.Array]:
    columns = pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    return [x[0] if len(x) == 1 else x[0][x[1]] for x in columns]


def first(key: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Which cells have the k smallest keys of their row; earlier cells, that is smaller labels, win ties."""
    taken = np.zeros(len(key), bool)
    if not len(key):
        return taken
    if (size == size[0]).all():
        if k < 8 and size[0] > 2 * k and np.isfinite(key).all():  # k passes are quicker than sorting whole rows
            left, grid, row = np.array(key, float).reshape(len(size), -1), taken.reshape(len(size), -1), np.arange(len(size))
            for _ in range(k):
                at = left.argmin(axis=1)
                grid[row, at], left[row, at] = True, np.inf
            return taken
        order = np.argsort(key.reshape(len(size), -1), axis=1, kind="stable")[:, :k]
        np.put_along_axis(taken.reshape(len(size), -1), order, True, axis=1)
        return taken
    order = np.lexsort((key, np.repeat(np.arange(len(size)), size)))
    place = np.arange(len(key)) - np.repeat(np.cumsum(size) - size, size)
    taken[order[place < k]] = True
    return taken


def largest(gain: np.ndarray, size: np.ndarray, k: int) -> np.ndarray:
    """Which cells have the k largest gains of their row, or with k = 0 a gain of at least 0."""
    return first(-gain, size, k) if k > 0 else gain >= 0


def totals(rows: DataFrame, m: int, count: int, sums: Callable[[pa.RecordBatch], tuple], by: str | None = None) -> dict[int, tuple[int, np.ndarray]]:
    """{part: (number of rows, array [count, m])}: sums by label, for each value of `by`.

    `sums` gives (at, values, ...) of a batch's cells. A task adds up its batches and gives a row for each label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, list] = {}
        for batch in batches:
            parts = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, int)
            for part in np.unique(parts):
                some = batch if len(parts) == 0 or (parts == part).all() else batch.filter(pa.array(parts == part))
                at, *values = sums(some)
                now = own.setdefault(int(part), [0, np.zeros((count, m))])
                now[0] += some.num_rows
                now[1] += np.array([np.bincount(at, v, m) for v in values]).reshape(count, m)
        for part, (n, c) in own.items():
            at = np.flatnonzero(c.any(axis=0))
            out = [np.append(at, -1), *(np.append(x[at], n) for x in c)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at) + 1, part)), *(pa.array(x) for x in out)], names=["part", "at", *(f"s{i}" for i in range(count))])

    schema = "part bigint, at bigint" + "".join(f", s{i} double" for i in range(count))
    added = rows.mapInArrow(run, schema).groupBy("part", "at").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(count)])
    out: dict[int, tuple[int, np.ndarray]] = {}
    for r in added.collect():  # a row for each label
        n, c = out.get(r["part"], (0, np.zeros((count, m))))
        if r["at"] < 0:
            n = int(r["s0"])
        else:
            c[:, r["at"]] = [r[f"s{i}"] for i in range(count)]
        out[r["part"]] = n, c
    return out


def sequential(size: np.ndarray, at: np.ndarray, state: np.ndarray, decide: Callable, effect: Callable, *, most: int = 2_000_000, block: int = 1024) -> np.ndarray:
    """Decisions on rows one after another, where `state` [sums, m] before a row holds the effects of all rows before it.

    decide(cells, c, row) gives the decisions on the cells of a slice at their labels' state c [sums, cells], effect(cells,
    chosen) what they add to it [sums, cells]. Within a block all decisions are guessed, the state before each row follows
    from them, and decisions are made anew until nothing changes; a pass makes at least one more row final, so the
    outcome is the sequential one. `state` moves on to the last row. A block's rows times its labels are at most `most`.
    """
    ends, chosen, low = np.concatenate([[0], np.cumsum(size)]), np.zeros(len(at), bool), 0
    while low < len(size):
        high = min(len(size), low + block)
        while True:
            cells = slice(ends[low], ends[high])
            names, column = np.unique(at[cells], return_inverse=True)
            if high - low == 1 or (high - low) * len(names) <= most:
                break
            high = low + (high - low) // 2
        row = np.repeat(np.arange(high - low), size[low:high])
        before, guess = np.repeat(state[:, None, names], high - low + 1, axis=1), None
        while True:
            fresh = decide(cells, before[:, row, column], row + low, size[low:high])
            if guess is not None and (fresh == guess).all():
                break
            guess = fresh
            steps = np.zeros((len(state), high - low + 1, len(names)))
            steps[:, 0] = state[:, names]
            steps[:, row + 1, column] = effect(cells, guess)
            before = np.cumsum(steps, axis=1)
        chosen[cells], state[:, names], low = guess, before[:, -1], high
    return chosen
