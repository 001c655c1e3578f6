"""Online learners: predict, see the label, update. Exact replay by one ordered state, and micro-batches.

`replay` runs a learner over rows in arrival order with state of 4 numbers for each label (`by_label` is its
form for labels side by side); `start` is its streaming form, where weights are frozen within a micro-batch
and updated after it, and what is known is kept with the stream's checkpoint.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave.functions.metrics import Metric
from labelweave.operators import select
from labelweave.operators.batches import as_arrays, largest, lists, placed, sequential, totals
from labelweave.operators.block_coordinate import gain as gain_of
from labelweave.operators.confusion import ENTRIES
from labelweave.operators.packed import label_ids
from labelweave.shared import Scratch
from labelweave.streaming.by_label import replay_by_label
from labelweave.streaming.state import LearnerStore


@dataclass
class Learner:
    """State and rule of an online learner over m labels.

    kind: default (top k, or scores of 0.5 and more), greedy (one block-coordinate step), gradient
    (linear weights from the metric's gradient at the running matrix), thresholds (F-measure, macro or
    micro).
    """

    kind: str
    metric: Metric
    k: int
    m: int
    regularize: float = 1e-6
    n: int = 0
    c: np.ndarray = field(default=None)
    names: np.ndarray | None = None

    def labels_at(self, index: np.ndarray) -> np.ndarray | None:
        return None if self.names is None else self.names[index]

    def __post_init__(self):
        if self.c is None:
            self.c = np.full((4, self.m), self.regularize)

    def choose(self, index: np.ndarray, eta: np.ndarray) -> np.ndarray:
        if self.kind == "default":
            g = eta if self.k else eta - 0.5
        elif self.kind == "greedy":
            n, c = self.n + 1, self.c[:, index]
            up = [c[0] + eta, c[1] + 1 - eta, c[2], c[3]]
            down = [c[0], c[1], c[2] + eta, c[3] + 1 - eta]
            g = self.metric.at(*(x / n for x in up), self.labels_at(index)) - self.metric.at(*(x / n for x in down), self.labels_at(index))
            if self.metric.mix != 1:
                g = self.metric.mix / self.m * g + (1 - self.metric.mix) * eta / n / self.metric.k
        elif self.kind == "gradient":
            d = self.metric.gradient(*(self.c / max(1, self.n)), label=self.names)
            a, b = (d[0] - d[1] - d[2] + d[3])[index], (d[1] - d[3])[index]
            g = a * eta + b
        elif self.kind == "thresholds":
            g = eta - f_thresholds(*self.c[:3], average=self.metric.average)[index]
        else:
            raise ValueError(self.kind)
        return np.lexsort((index, -g))[: self.k] if self.k else np.flatnonzero(g >= 0)

    def update(self, index: np.ndarray, y: np.ndarray, chosen: np.ndarray) -> None:
        yh = np.zeros(len(index))
        yh[chosen] = 1
        self.n += 1
        self.c[3] += 1
        self.c[3, index] += (1 - y) * (1 - yh) - 1
        for row, part in enumerate((y * yh, (1 - y) * yh, y * (1 - yh))):
            self.c[row, index] += part


def f_thresholds(tp, fp, fn, average: str = "macro"):
    """The thresholds that online F-measure optimization has reached: half of each label's F1, or of all labels' together.

    For columns tp, fp and fn of one label a column, for arrays an array.
    """
    if isinstance(tp, Column):
        return tp / (2 * tp + fp + fn)
    hit, all_ = tp, 2 * tp + fp + fn
    return hit / all_ if average == "macro" else np.full(len(hit), hit.sum() / all_.sum())


#: Learners by name: kind, and whether they take a number of labels k or thresholds.
KINDS = {"default": "default", "greedy": "greedy", "omma": "gradient", "ofo": "thresholds"}


def learn_online(name: str, rows: DataFrame, labels: DataFrame, k: int, *, alpha: float = 0.5, etu: bool = False, **options) -> DataFrame:
    """Predictions of the learner `method_objective`, such as omma_macro_f1, greedy_macro_recall, ofo_micro_f1, frank_wolfe_macro_f1, thresholds_macro_f1 or default.

    With etu the scores stand for the labels, so the learner optimizes expected utility and sees no label.
    """
    from labelweave.operators.named import objective

    rows = rows.withColumn("y", F.col("eta")) if etu else rows
    method = next(x for x in ("frank_wolfe", "thresholds", *KINDS) if name == x or name.startswith(f"{x}_"))
    metric = objective(name.removeprefix(method).lstrip("_") or "macro_f1", max(1, k), alpha)
    if method in ("frank_wolfe", "thresholds"):
        return replay_retuned(rows, labels, method, metric, k, **options)
    if not k and getattr(metric, "average", "") == "macro" and metric.mix == 1:
        return replay_by_label(rows, KINDS[method], metric, **options)
    return replay(rows, labels, KINDS[method], metric, k, **options)


def replay(rows: DataFrame, labels: DataFrame, kind: str, metric: Metric, k: int, *, order: str = "instance_id", chunk: int = 250_000) -> DataFrame:
    """(instance_id, label_id, value): predictions of a learner over rows (instance_id, label_id, eta, y, ...) in arrival order.

    rows may be packed, with cells (label_id, eta, y). Learners that choose k labels weigh a row's labels against each
    other, so their strict order needs one task at a time; rows are sorted in parallel and pass in chunks of about
    `chunk` rows, a task for each, and what is known, a few numbers for each label, goes on to the next. Within a
    task blocks of rows are decided at once (`batches.sequential`). `replay_by_label` has no such task, and
    `start` freezes weights within a micro-batch. A learner without state (default) needs no order at all.
    """
    if kind == "default":
        rows = rows.select("instance_id", F.inline("cells")) if "cells" in rows.columns else rows
        return select.predict(rows.select("instance_id", F.col("label_id").cast("int").alias("label_id"), "eta"), k, th=0.5)
    names, scratch = label_ids(labels), Scratch(rows.sparkSession)
    keys = list(dict.fromkeys((order, "instance_id")))
    flat = scratch.save(cells_of(rows, *keys).select(*keys, *as_arrays("label_id", "eta", "y")))
    parts = max(1, -(-flat.count() // chunk))
    sorted_ = scratch.save(flat.repartitionByRange(parts, *keys).withColumn("part", F.spark_partition_id()), by=("part",))
    state, seen, done = np.array([[1e-6] * len(names)] * 3 + [[0.0] * len(names)]), 0, []
    for part in range(parts):
        own = sorted_.where(F.col("part") == part).drop("part").coalesce(1).sortWithinPartitions(*keys).select("instance_id", "label_id", "eta", "y")
        found = scratch.save(own.mapInArrow(_replayer(kind, metric, k, names, state, seen), f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, label_id int, value double, state array<double>, seen bigint"))
        last = found.where("state is not null").select("state", "seen").collect()  # one row
        if last:
            state, seen = np.array(last[0].state).reshape(state.shape), last[0].seen
        done.append(found)
    return functools.reduce(DataFrame.unionByName, done).where("state is null").select("instance_id", "label_id", "value")


def cells_of(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with cells (label_id, eta, y), which may be there already."""
    if "cells" in rows.columns:
        return rows
    return rows.groupBy(*(keys or ("instance_id",))).agg(F.sort_array(F.collect_list(F.struct("label_id", "eta", "y"))).alias("cells"))


def _replayer(kind: str, metric: Metric, k: int, names: np.ndarray, state: np.ndarray, seen: int) -> Callable:
    """A learner's decisions on rows (instance_id, label_id, eta, y) in order, and a last row with what it knows then.

    state is tp, fp, fn and what is taken off tn, for each label. Micro averages and combined metrics, where each label
    depends on all others, go row by row.
    """
    apart, m = isinstance(metric, Metric) and (metric.average in ("macro", "sum") or kind == "greedy"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, n, kind_of_id = state.copy(), seen, None
        for batch in batches:
            size, label, eta, y = lists(batch, "label_id", "eta", "y")
            at, row = np.searchsorted(names, label), np.repeat(np.arange(len(size)), size)

            def decide(cells: slice, c: np.ndarray, row: np.ndarray, size: np.ndarray) -> np.ndarray:
                e, pos, own = eta[cells], n + row, names[at[cells]]  # noqa: B023
                counts = [c[0], c[1], c[2], 1e-6 + pos - c[3]]
                if kind == "thresholds":
                    g = e - f_thresholds(*counts[:3])
                elif kind == "greedy":
                    g = gain_of(metric, *counts, e, pos + 1, m, own)
                else:
                    d = metric.gradient(*(x / np.maximum(1, pos) for x in counts), label=own)
                    if metric.average == "macro":  # the mean is over labels, not over these cells
                        mixed = (1 - metric.mix) / metric.k if metric.mix != 1 else 0.0
                        d = [(d[0] - mixed) * len(e) / m + mixed, *(x * len(e) / m for x in d[1:])]
                    g = (d[0] - d[1] - d[2] + d[3]) * e + (d[1] - d[3])
                return largest(g, size, k)

            def effect(cells: slice, chosen: np.ndarray) -> np.ndarray:
                t, p = y[cells], chosen.astype(float)  # noqa: B023
                return np.stack([t * p, (1 - t) * p, t * (1 - p), 1 - (1 - t) * (1 - p)])

            if apart:
                chosen = sequential(size, at, now, decide, effect)
            else:
                chosen, cuts = np.zeros(len(at), bool), np.concatenate([[0], np.cumsum(size)])
                learner = Learner(kind, metric, k, m, n=n, c=np.concatenate([now[:3], 1e-6 + n - now[3:]]), names=names)
                for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                    own = learner.choose(at[low:high], eta[low:high])
                    learner.update(at[low:high], y[low:high], own)
                    chosen[low + own] = True
                now = np.concatenate([learner.c[:3], 1e-6 + learner.n - learner.c[3:]])
            n, kind_of_id, count = n + len(size), batch.column("instance_id").type, int(chosen.sum())
            none = pa.nulls(count, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("instance_id").take(pa.array(row[chosen])), pa.array(label[chosen].astype(np.int32)), pa.array(np.ones(count)), none, pa.nulls(count, pa.int64())], names=["instance_id", "label_id", "value", "state", "seen"])
        if kind_of_id is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind_of_id), pa.nulls(1, pa.int32()), pa.nulls(1, pa.float64()), pa.array([now.ravel().tolist()], pa.list_(pa.float64())), pa.array([n], pa.int64())], names=["instance_id", "label_id", "value", "state", "seen"])

    return run


class BatchLearner:
    """A learner whose weights are frozen within a batch of cells (instance_id, label_id, eta, y) and updated after it.

    A batch may come packed, with cells (label_id, eta, y). It is written once as arrays and worked on in parallel, and
    only sums by label come to the driver. With a store the state of each batch outlives the process: a new learner
    goes on where the last one stopped, and a batch that comes again is answered from the state before it.
    """

    def __init__(self, labels: DataFrame, metric: Metric, k: int, *, kind: str = "gradient", store: LearnerStore | None = None):
        self.names, self.store, self.version = label_ids(labels), store, -1
        self.kind, self.metric, self.k = kind, metric, k
        self.state = Learner(kind, metric, k, len(self.names), names=self.names)

    def _restore(self, number: int) -> None:
        """The state before batch `number`; labels that the stored one lacks begin anew."""
        if self.store is None or self.version == number - 1 >= 0:
            return
        found = self.store.before(number)
        self.state = Learner(self.kind, self.metric, self.k, len(self.names), names=self.names)
        if found:
            _, self.state.n, old = found
            new = [self.state.regularize] * 3 + [self.state.n + self.state.regularize]
            self.state.c = np.array([old.get(int(j), new) for j in self.names], float).reshape(-1, 4).T

    def _picker(self) -> Callable:
        """A function from a batch of arrays to (size, at, y, picked): its cells, and which are chosen by the weights as they stand."""
        kind, metric, k, names, n, known = self.kind, self.metric, self.k, self.names, self.state.n, self._known()

        def pick(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            size, at, eta, y = placed(names, *lists(batch, "label_id", "eta", "y"))
            own = {x: v[at] for x, v in known.items()}
            if kind == "default":
                g = eta if k else eta - 0.5
            elif kind == "thresholds":
                g = eta - own["th"]
            elif kind == "gradient":
                g = own["a"] * eta + own["b"]
            else:
                g = gain_of(metric, *(own[c] for c in ENTRIES), eta, float(n + 1), len(names), names[at])
            return size, at, np.nan_to_num(y), largest(g, size, k)

        return pick

    def _known(self) -> dict[str, np.ndarray]:
        if self.kind == "thresholds":
            return {"th": f_thresholds(*self.state.c[:3], average=self.metric.average)}
        if self.kind == "gradient":
            d = self.metric.gradient(*(self.state.c / max(1, self.state.n)), label=self.names)
            return {"a": d[0] - d[1] - d[2] + d[3], "b": d[1] - d[3]}
        return dict(zip(ENTRIES, self.state.c, strict=True))

    def step(self, cells: DataFrame, number: int, sink: Callable[[DataFrame, int], None]) -> None:
        """Predictions of one batch go to the sink, which has to use them before it returns and to replace what an earlier try has left; then the state is saved."""
        self._restore(number)
        scratch, pick, names = Scratch(cells.sparkSession), self._picker(), self.names
        rows = scratch.save(cells_of(cells).select("instance_id", *as_arrays("label_id", "eta", "y")))

        def predictions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                size, at, _, picked = pick(batch)
                row = np.repeat(np.arange(len(size)), size)[picked]
                yield pa.RecordBatch.from_arrays([batch.column("instance_id").take(pa.array(row)), pa.array(names[at[picked]].astype(np.int32)), pa.array(np.ones(len(row)))], names=["instance_id", "label_id", "value"])

        def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
            _, at, y, picked = pick(batch)
            return at, y * picked, picked.astype(float), y

        sink(rows.mapInArrow(predictions, f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, label_id int, value double"), number)
        n, (hit, p, positive) = totals(rows, len(names), 3, sums).get(0, (0, np.zeros((3, len(names)))))
        scratch.drop()
        self.state.n += n
        self.state.c = self.state.c + np.array([hit, p - hit, positive - hit, n - p - positive + hit])
        self.version = number
        if self.store is not None:
            self.store.save(number, self.state.n, self.names, self.state.c)


def start(stream: DataFrame, labels: DataFrame, metric: Metric, k: int, sink: Callable[[DataFrame, int], None], checkpoint: str, *, kind: str = "gradient"):
    """Run a learner over a stream of cells (instance_id, label_id, eta, y); sink gets each batch's predictions. Returns the query and the learner.

    The learner's states are kept in the folder `learner` of the checkpoint, so a query that starts again on it
    goes on with all that was learned. A batch may come twice after a crash; with a sink that replaces by batch
    number (`state.batches_to`) every row is there once. All kinds of Learner can be run.
    """
    learner = BatchLearner(labels, metric, k, kind=kind, store=LearnerStore(stream.sparkSession, f"{checkpoint}/learner"))
    writer = stream.writeStream.foreachBatch(lambda cells, number: learner.step(cells, number, sink))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(), learner


def prequential(rows: DataFrame, by: str = "instance_id", every: int = 100, wide: int = 1000) -> DataFrame:
    """(position, hits, precision): running share of right predictions (rows with `hit` and `n`) after each `every` rows.

    Rows are summed in blocks first, and blocks in groups of `wide`; sums run over groups, and over the
    blocks of each group apart.
    """
    blocks = rows.groupBy(F.floor(F.col(by) / every).alias("block")).agg(F.sum("hit").alias("hit"), F.sum("n").alias("n")).withColumn("group", F.floor(F.col("block") / wide))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # 1 / (every * wide) of the rows
    groups = blocks.groupBy("group").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    groups = groups.select("group", F.coalesce(F.sum("hit").over(before), F.lit(0)).alias("hits_before"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    run = Window.partitionBy("group").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = blocks.select("group", "block", F.sum("hit").over(run).alias("hits"), F.sum("n").over(run).alias("n")).join(groups, "group")
    hits, n = F.col("hits") + F.col("hits_before"), F.col("n") + F.col("n_before")
    return total.select(F.col("block").alias("position"), hits.alias("hits"), F.when(n > 0, hits / n).alias("precision"))


#: Growth of the number of rows after which a learner learns again.
GROWTH = {"thresholds": 1.5, "frank_wolfe": 1.1}


def replay_retuned(rows: DataFrame, labels: DataFrame, kind: str, metric: Metric, k: int, *, first: int = 100, growth: float | None = None, max_iters: int = 25, afresh: bool = False) -> DataFrame:
    """Predictions by parameters that are learned again each time the number of earlier rows has grown by `growth`.

    kind: thresholds (a threshold for each label on all earlier rows, at first 0.5) or frank_wolfe (a randomized
    classifier, at first top k, carried on over the rows of the last period alone; with `afresh` it is found on all
    earlier rows each time). Arrival order is instance_id. There are as many periods as a logarithm of the rows.
    rows may be packed, with cells (label_id, eta, y).
    """
    growth = growth or GROWTH[kind]
    if kind == "frank_wolfe":
        return _replay_frank_wolfe(rows, labels, metric, k, first=first, growth=growth, max_iters=max_iters, afresh=afresh)
    return _replay_thresholds(rows, metric.name if metric.name == "min_tp_tn" else "f1", first=first, growth=growth)


def _starts(low: int | None, high: int | None, first: int, growth: float) -> list[int]:
    """The first instance of each period."""
    starts, start, size = [], low, first
    while low is not None and start <= high:
        starts.append(start)
        start, size = max(start + 1, low + int(size)), size * growth
    return starts


def _replay_thresholds(rows: DataFrame, metric: str, *, first: int, growth: float) -> DataFrame:
    """Rows are written once; the thresholds of all periods are found together, as they don't depend on decisions."""
    scratch = Scratch(rows.sparkSession)
    stored = scratch.save(rows.select("instance_id", "cells") if "cells" in rows.columns else rows.select("instance_id", "label_id", "eta", "y"))
    starts = _starts(*stored.agg(F.min("instance_id"), F.max("instance_id")).first(), first, growth)
    period = functools.reduce(Column.__add__, [(F.col("instance_id") >= x).cast("int") for x in starts[1:]], F.lit(0)).alias("period")
    cells = stored.select("instance_id", period, *([F.inline("cells")] if "cells" in stored.columns else ["label_id", "eta", "y"]))
    found = cells.withColumn("th", F.lit(0.5))
    if len(starts) > 1:
        th = scratch.save(select.tune_by_period(cells, len(starts), metric).select("period", "label_id", "th"))
        found = cells.join(th, ["period", "label_id"], "left").withColumn("th", F.when(F.col("period") == 0, 0.5).otherwise(F.col("th")))
    return found.where("eta >= th").select("instance_id", "label_id", F.lit(1.0).alias("value"))


def _replay_frank_wolfe(rows: DataFrame, labels: DataFrame, metric: Metric, k: int, *, first: int, growth: float, max_iters: int, afresh: bool, chunk: int = 250_000) -> DataFrame:
    """Rows are written once as arrays, in ranges of arrival, a folder for each period; a period's search reads the folders that it learns from."""
    from labelweave.operators import frank_wolfe

    names, scratch = label_ids(labels), Scratch(rows.sparkSession)
    draw = F.pmod(F.xxhash64("instance_id", F.lit(0)), F.lit(1 << 30)) / float(1 << 30)
    flat = scratch.save(cells_of(rows).select("instance_id", draw.alias("u"), *as_arrays("label_id", "eta", "y")))
    low, high, n = flat.agg(F.min("instance_id"), F.max("instance_id"), F.count("*")).first()
    starts = _starts(low, high, first, growth)
    edges = F.array(*[F.lit(x) for x in starts]).cast("array<bigint>")
    period = F.size(F.filter(edges, lambda x: x <= F.col("instance_id"))) - 1
    stored = scratch.save(flat.repartitionByRange(max(1, -(-n // chunk)), "instance_id").withColumn("period", period), by=("period",))
    out, found = [], None
    for i in range(len(starts)):
        if i:
            seen = stored.where(F.col("period") < i) if afresh else stored.where(F.col("period") == i - 1)
            found = frank_wolfe.carry_on(None if afresh else found, seen.select("label_id", "eta", "y"), names, metric, k, max_iters=max_iters)
        out.append(frank_wolfe.drawn_labels(found, stored.where(F.col("period") == i).select("instance_id", "u", "label_id", "eta"), names, k))
    if not out:
        out.append(frank_wolfe.drawn_labels(None, stored.select("instance_id", "u", "label_id", "eta"), names, k))
    return functools.reduce(DataFrame.unionByName, out)
