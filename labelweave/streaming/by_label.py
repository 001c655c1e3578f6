"""Exact online replay with a state for each label, labels side by side.

Without a number of labels to choose (k = 0) and with a macro average, whether a label is predicted depends
on its own scores and its own past. Rows are sorted by label and arrival, and a label's rows pass through
in blocks with four numbers of state. Within a block the sequential rule is solved at once: guess all
decisions, derive the state before each row from the decisions so far, decide anew, until nothing changes.
A pass makes at least one more row final, so the outcome is the sequential one; a few passes are the rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.metrics import Metric
from labelweave.operators.batches import as_arrays, lists, squeezed, unsqueezed
from labelweave.operators.places import placed

#: Rows of a label that are decided at once, and cells that a task holds to make columns of them.
BLOCK, HELD = 4096, 2_000_000


def arrival(rows: DataFrame, order: str = "instance_id") -> DataFrame:
    """rows with `pos`, the place of each instance in arrival order, from 0.

    Instances are sorted over all partitions and written; only the partitions' sizes are counted on the driver.
    """
    keys = list(dict.fromkeys((order, "instance_id")))
    return _in_order(rows, keys).select(*keys, "pos", F.inline("cells"))


def _in_order(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Packed rows (keys, pos, cells); rows that are packed, or have their places, are so already."""
    if "cells" not in rows.columns:
        others = [c for c in rows.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("cells"))
    return rows if "pos" in rows.columns else placed(rows.select(*keys, "cells"), *keys)


def _columns(held: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(label_id, pos, cells): from rows (instance_id, pos, label_id, eta, y as arrays) pieces of one label's column, each with the place where it begins.

    Rows with the places from that one on follow one another in a piece, so pieces never overlap, however the rows lie.
    """

    def pieces(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        size, label, eta, y = lists(rows, "label_id", "eta", "y")
        pos, ids = rows.column("pos").to_numpy(), rows.column("instance_id")
        stretch = np.concatenate([[0], np.cumsum(np.diff(pos) != 1)])
        row = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((label, stretch[row])) if stretch[-1] else np.argsort(label, kind="stable")
        label, eta, y, row = label[order], eta[order], y[order], row[order]
        cuts = np.flatnonzero((np.diff(label) != 0) | (np.diff(stretch[row]) != 0)) + 1
        starts, stops = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(label)]])
        whole = ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else None
        out = []
        for a, b in zip(starts, stops, strict=True):
            own, place = row[a:b], pos[row[a:b]]
            out.append(squeezed(ids.take(pa.array(own)) if whole is None else np.diff(whole[own], prepend=whole.dtype.type(0)), np.diff(place, prepend=place[:1]), eta[a:b], y[a:b]))
        return pa.RecordBatch.from_arrays([pa.array(label[starts].astype(np.int32)), pa.array(pos[row[starts]]), pa.array(out, pa.binary())], names=["label_id", "pos", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, count = [], 0
        for batch in batches:
            cells = len(batch.column("label_id").flatten())
            if cells:
                waiting, count = [*waiting, batch], count + cells
            if count >= held:
                yield pieces(waiting)
                waiting, count = [], 0
        if waiting:
            yield pieces(waiting)

    return run


class Rule:
    """Whether a label is predicted, given counts before each row."""

    def __init__(self, kind: str, metric: Metric, regularize: float):
        if kind not in ("default", "greedy", "gradient", "thresholds"):
            raise ValueError(kind)
        self.kind, self.metric, self.regularize = kind, metric, regularize

    def __call__(self, c: list[np.ndarray], pos: np.ndarray, eta: np.ndarray, label: int) -> np.ndarray:
        if self.kind == "default":
            return eta >= 0.5
        tp, fp, fn, tn = c
        if self.kind == "thresholds":
            return eta >= tp / (2 * tp + fp + fn)
        names = np.full(len(eta), label)
        if self.kind == "gradient":
            n = np.maximum(1, pos)
            d = self.metric.gradient(tp / n, fp / n, fn / n, tn / n, label=names)
            return (d[0] - d[1] - d[2] + d[3]) * eta + d[1] - d[3] >= 0
        n = pos + 1
        up = self.metric.at((tp + eta) / n, (fp + 1 - eta) / n, fn / n, tn / n, names)
        return up - self.metric.at(tp / n, fp / n, (fn + eta) / n, (tn + 1 - eta) / n, names) >= 0

    def settle(self, state: np.ndarray, pos: np.ndarray, eta: np.ndarray, y: np.ndarray, label: int) -> np.ndarray:
        """Decisions on one label's rows in order; state (tp, fp, fn and what is taken off tn) moves on to the last of them."""
        before = np.repeat(state[:, None], len(eta) + 1, axis=1)
        chosen: np.ndarray | None = None
        while True:
            c = [before[0, :-1], before[1, :-1], before[2, :-1], self.regularize + pos - before[3, :-1]]
            fresh = self(c, pos, eta, label)
            if chosen is not None and (fresh == chosen).all():
                break
            chosen = fresh
            p = chosen.astype(float)
            steps = np.stack([y * p, (1 - y) * p, y * (1 - p), 1 - (1 - y) * (1 - p)])
            before = np.cumsum(np.concatenate([state[:, None], steps], axis=1), axis=1)
        state[:] = before[:, -1]
        return chosen


def replay_by_label(rows: DataFrame, kind: str, metric: Metric, *, order: str = "instance_id", regularize: float = 1e-6, partitions: int | None = None, block: int = BLOCK, held: int = HELD) -> DataFrame:
    """(instance_id, label_id, value): the sequential learner's predictions over rows (instance_id, label_id, eta, y, ...) for k = 0.

    kind is default, greedy, gradient or thresholds, as in `online.Learner`. A label that a row does not list
    counts as a true negative there. rows may be packed, with cells (label_id, eta, y), and may have their places in
    arrival order (pos, from 0 without a gap, as from `placed`). Labels are spread over `partitions` tasks (the
    shuffle's by default), to which their columns go compressed, about `held` cells of all labels at a time; a
    label's own rows follow one another, as each depends on those before.
    """
    if metric.average != "macro" or metric.mix != 1:
        raise ValueError("labels can only be replayed apart for a macro average")
    rule, spark = Rule(kind, metric, regularize), rows.sparkSession
    keys, id_type = list(dict.fromkeys((order, "instance_id"))), rows.schema["instance_id"].dataType.simpleString()
    rows = rows if "cells" in rows.columns else rows.select(*keys, "label_id", "eta", "y")
    arrays = _in_order(rows, keys).select("instance_id", F.col("pos").cast("bigint").alias("pos"), *as_arrays("label_id", "eta", "y"))
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = arrays.mapInArrow(_columns(held), "label_id int, pos bigint, cells binary").repartition(partitions, "label_id").sortWithinPartitions("label_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, waiting, found = None, np.zeros(4), [], []

        def decide(now: int, state: np.ndarray) -> None:
            """Decisions on what waits of the label; what is chosen goes to `found`."""
            ids, pos, eta, y = ([x[i] for x in waiting] for i in range(4))
            ids, pos, eta, y = pa.concat_arrays(ids), *(np.concatenate(x) for x in (pos, eta, y))
            chosen = np.zeros(len(pos), bool)
            for low in range(0, len(pos), block):
                own = slice(low, low + block)
                chosen[own] = rule.settle(state, pos[own], eta[own], y[own], now)
            ids = ids.filter(pa.array(chosen))
            if len(ids):
                found.append(pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), now, np.int32)), pa.array(np.ones(len(ids)))], names=["instance_id", "label_id", "value"]))
            waiting.clear()

        def all_found() -> Iterator[pa.RecordBatch]:
            yield from pa.Table.from_batches(found).combine_chunks().to_batches()
            found.clear()

        for batch in batches:
            for label, first, data in zip(*(batch.column(c).to_pylist() for c in ("label_id", "pos", "cells")), strict=True):
                if label != now:
                    if waiting:
                        decide(now, state)
                    now, state = label, np.array([regularize, regularize, regularize, 0.0])
                ids, gap, eta, y = unsqueezed(data)
                ids = ids if isinstance(ids, pa.Array) else pa.array(np.cumsum(ids, dtype=ids.dtype))
                waiting.append((ids, first + np.cumsum(gap), eta, y))
                if len(waiting) >= 100 or sum(len(x[1]) for x in waiting) >= block:
                    decide(now, state)
                if len(found) >= 100 or sum(x.num_rows for x in found) >= 10_000:
                    yield from all_found()
        if waiting:
            decide(now, state)
        if found:
            yield from all_found()

    return ordered.mapInArrow(run, f"instance_id {id_type}, label_id int, value double")
