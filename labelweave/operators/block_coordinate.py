"""Test-set optimisation by block-coordinate steps: each row's labels are chosen anew against the rest.

`minibatch` is the distributed form: rows fall into hash slices, other ones in each sweep, one slice at a
time is chosen against the confusion matrix without each row's own contribution, and only sums for each
label return. `exact` visits row after row in one task, for sets that fit there. Slices are not run side by side, since
blocks that chase the same labels overshoot.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.functions.metrics import Metric
from labelweave.operators.batches import as_lists, first, largest, lists, totals
from labelweave.operators.confusion import ENTRIES
from labelweave.operators.packed import cells_in_rows, label_ids, packed
from labelweave.operators.select import best, predict, random_at_k
from labelweave.shared import Scratch


def gain(metric: Metric, tp: Column, fp: Column, fn: Column, tn: Column, eta: Column, n: Column | float, m: int, label: Column | None = None) -> Column:
    """What choosing a label adds to the metric, for counts that exclude the row itself."""
    scale = lambda *c: [x / n for x in c]
    value = metric.at(*scale(tp + eta, fp + 1 - eta, fn, tn), label) - metric.at(*scale(tp, fp, fn + eta, tn + 1 - eta), label)
    if metric.mix != 1:
        return metric.mix / m * value + (1 - metric.mix) * eta / n / metric.k
    return value


def slice_gains(eta: DataFrame, y_pred: DataFrame, conf: DataFrame, n: int, m: int, metric: Metric) -> DataFrame:
    """eta with the gain of each cell. conf holds counts over all n rows with y_pred; each row's own part is taken off first."""
    rows = eta.join(y_pred.withColumnRenamed("value", "chosen"), ["instance_id", "label_id"], "left").withColumn("chosen", F.coalesce("chosen", F.lit(0.0)))
    both = rows.join(F.broadcast(conf), "label_id")  # a row for each label
    e, c = F.col("eta"), F.col("chosen")
    own = {"tp": e * c, "fp": (1 - e) * c, "fn": e * (1 - c), "tn": (1 - e) * (1 - c)}
    rest = [F.greatest(F.lit(0.0), F.col(x) - own[x]) for x in ENTRIES]
    return both.withColumn("gain", gain(metric, *rest, e, F.lit(float(n)), m, F.col("label_id")))


def slice_step(eta: DataFrame, y_pred: DataFrame, conf: DataFrame, n: int, m: int, metric: Metric, k: int) -> DataFrame:
    """New labels of the rows in eta, each against the rest."""
    gains = slice_gains(eta, y_pred, conf, n, m, metric)
    return (best(gains, k) if k > 0 else gains.where("gain >= 0")).select("instance_id", "label_id", F.lit(1.0).alias("value"))


def initial(eta: DataFrame, k: int, init: str | DataFrame, seed: int) -> DataFrame:
    """The first prediction: top, random (k labels of each row, one if k is 0), greedy (none), or the one given."""
    if isinstance(init, DataFrame):
        return init
    if init == "greedy":
        return eta.select("instance_id", "label_id", F.lit(1.0).alias("value")).limit(0)
    if init == "random":
        return random_at_k(eta, max(1, k), seed)
    if init != "top":
        raise ValueError("init has to be top, random, greedy or a table")
    return predict(eta, k, th=0.5)


def dealt(seed: int, slices: int) -> Callable[[int], Column]:
    """The slice of each instance in a sweep: a hash that is another one in each sweep, so that rows meet in new company."""
    return lambda sweep: F.pmod(F.xxhash64("instance_id", F.lit(seed), F.lit(sweep)), F.lit(slices)).cast("int")


def start_rows(eta: DataFrame, names: np.ndarray, k: int, init: str | DataFrame = "top", seed: int = 0) -> DataFrame:
    """(instance_id, at, eta, c): packed rows as lists, with each label's place in names and the first prediction."""
    kind = f"instance_id {eta.schema['instance_id'].dataType.simpleString()}, at array<int>, eta array<double>, c array<boolean>"
    first_of = {"top": lambda e, size, more: largest(e if k > 0 else e - 0.5, size, k), "greedy": lambda e, size, more: np.zeros(len(e), bool), "random": lambda e, size, more: first(~more, size, max(1, k)), "given": lambda e, size, more: more > 0}
    if isinstance(init, DataFrame):
        own = eta.select("instance_id", F.inline("cells")) if "cells" in eta.columns else eta
        rows, init, more = packed(own, names, c=init), "given", F.transform("cells", lambda x: x["c"])
    else:
        if init not in first_of:
            raise ValueError("init has to be top, random, greedy or a table")
        rows, more = cells_in_rows(eta), F.transform("cells", lambda x: F.xxhash64("instance_id", x["label_id"], F.lit(seed)) if init == "random" else F.lit(0).cast("bigint"))
    rows = rows.select("instance_id", F.transform("cells", lambda x: x["label_id"]).alias("label"), F.transform("cells", lambda x: x["eta"].cast("double")).alias("eta"), *([more.alias("more")] if init in ("random", "given") else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, label, e, *more = lists(batch, *batch.schema.names[1:])
            more, at = more[0] if more else e, np.searchsorted(names, label)
            known = names[np.minimum(at, len(names) - 1)] == label if len(names) else np.zeros(len(at), bool)
            if not known.all():
                size = np.bincount(np.repeat(np.arange(len(size)), size)[known], minlength=len(size))
                at, e, more = at[known], e[known], more[known]
                batch, size = batch.filter(pa.array(size > 0)), size[size > 0]
            c = first_of[init](e, size, more)
            yield pa.RecordBatch.from_arrays([batch.column("instance_id"), as_lists(size, at.astype(np.int32)), as_lists(size, e), as_lists(size, c)], names=["instance_id", "at", "eta", "c"])

    return rows.mapInArrow(run, kind)


def picked(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """(instance_id, label_id, value): the chosen cells of rows (instance_id, at, eta, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, c = lists(batch, "at", "c")
            own = np.repeat(np.arange(len(size)), size)[c]
            yield pa.RecordBatch.from_arrays([batch.column("instance_id").take(pa.array(own)), pa.array(names[at[c]].astype(np.int32)), pa.array(np.ones(len(own)))], names=["instance_id", "label_id", "value"])

    return rows.select("instance_id", "at", "c").mapInArrow(run, f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, label_id int, value double")


def _chooser(gains: Callable, k: int, sign: int, inside: float, n: int, known: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One step over rows (instance_id, at, eta, c): each row's labels anew, at sums by label `known`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, e, c = lists(batch, "at", "eta", "c")
            fresh = largest(sign * gains(at, e, c * inside, inside, n, known), size, k)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], as_lists(size, fresh)], names=["instance_id", "at", "eta", "c"])

    return run


def _sweeps(scratch: Scratch, start: DataFrame, names: np.ndarray, k: int, count: int, sums: Callable, gains: Callable, utility: Callable, *, slices: int, max_iters: int, tolerance: float, seen: bool, deal: Callable[[int], Column], maximize: bool) -> tuple[DataFrame, list[float]]:
    """(y_pred, utilities): sweeps over slices, dealt anew in each, until the utility improves by less than tolerance.

    `start` are written rows with the part of the first sweep. `sums` gives `count` values of each cell whose totals
    by label are the state, so no total drifts; `gains` reads the state, `utility` values it. A step is one pass over
    its slice, in which batches of rows are arrays: the rows are written with their new labels, in folders for the
    slices of the next sweep, and their sums are kept apart for these, so that the next sweep takes the slices as they
    lie and knows what each holds. A sweep's input is deleted when the sweep is done.
    """
    m = len(names)
    nothing = lambda: {s: np.zeros((count, m)) for s in range(slices)}
    measured = lambda df: totals(df.select("part", "at", "eta", "c"), m, count, lambda batch: (lambda size, at, e, c: (at, *sums(e, c)))(*lists(batch, "at", "eta", "c")), by="part")
    tables, found = [start], measured(start)
    state, rows = nothing() | {s: c for s, (_, c) in found.items()}, {s: 0 for s in range(slices)} | {s: n for s, (n, _) in found.items()}
    everyone, utilities, sign = sum(rows.values()), [], 1 if maximize else -1
    if seen:
        utilities.append(utility(sum(state.values()), max(1, everyone)))
    for sweep in range(max_iters):
        fresh_tables, fresh_state, fresh_rows, done = [], nothing(), {s: 0 for s in range(slices)}, 0
        for s in range(slices):
            if not rows[s]:
                continue
            now = functools.reduce(DataFrame.unionByName, [t.where(F.col("part") == s).drop("part") for t in tables])
            c = sum(fresh_state.values()) + (sum(state[q] for q in range(s, slices)) if seen else 0)
            fresh = now.mapInArrow(_chooser(gains, k, sign, float(seen), everyone if seen else done + rows[s], c), now.schema)
            written = scratch.save(fresh.withColumn("part", deal(sweep + 1)), by=("part",))
            fresh_tables.append(written)
            for q, (n, own) in measured(written).items():
                fresh_state[q], fresh_rows[q] = fresh_state[q] + own, fresh_rows[q] + n
            done += rows[s]
        if fresh_tables:
            tables, state, rows = fresh_tables, fresh_state, fresh_rows
            scratch.drop(keep=len(tables))
        seen = True
        utilities.append(utility(sum(state.values()), max(1, everyone)))
        if len(utilities) > 1 and sign * (utilities[-1] - utilities[-2]) < tolerance:
            break
    return picked(functools.reduce(DataFrame.unionByName, tables), names), utilities


def _entries(c: np.ndarray, n: float) -> list[np.ndarray]:
    """tp, fp, fn and tn from sums of eta * c, c and eta over n rows."""
    tp, p, e = c
    return [tp, p - tp, e - tp, n - p - e + tp]


def expected_gains(metric: Metric, names: np.ndarray, missing: int = 0) -> Callable[..., np.ndarray]:
    """The gain of each cell (at, eta, c) at sums of eta * c, c and eta over n rows, those rows' own part taken off where they are inside."""
    m = len(names)

    def gains(at: np.ndarray, e: np.ndarray, c: np.ndarray, inside: float, n: int, known: np.ndarray) -> np.ndarray:
        tp, p, t = known[0][at] - e * c, known[1][at] - c, known[2][at] - e * inside
        rest = [np.maximum(0.0, v) for v in (tp, p - tp, t - tp, (n + missing - 1) - p - t + tp)]
        return gain(metric, *rest, e, float(n + missing), m, names[at])

    return gains


def row_sums(rows: DataFrame, m: int) -> tuple[int, np.ndarray]:
    """(number of rows, sums of eta * c, c and eta by label) of rows (instance_id, at, eta, c)."""

    def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        _, at, e, c = lists(batch, "at", "eta", "c")
        return at, e * c, c.astype(float), e

    return totals(rows.select("at", "eta", "c"), m, 3, sums).get(0, (0, np.zeros((3, m))))


def step_gains(rows: DataFrame, names: np.ndarray, metric: Metric, k: int) -> DataFrame:
    """(instance_id, label_id, gain): the labels that one frozen step of all rows (`start_rows`) chooses, each row against the rest."""
    n, known = row_sums(rows, len(names))
    return _frozen_step(rows, names, expected_gains(metric, names), n, known, k)


def coverage_step_gains(rows: DataFrame, names: np.ndarray, k: int, alpha: float = 1.0) -> DataFrame:
    """(instance_id, label_id, gain): `step_gains` for coverage; the chance that no row hits a label is the only thing summed over rows."""

    def sums(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        _, at, e, c = lists(batch, "at", "eta", "c")
        return at, np.where(c, _log_miss(e), 0.0)

    n, known = totals(rows.select("at", "eta", "c"), len(names), 1, sums).get(0, (0, np.zeros((1, len(names)))))
    return _frozen_step(rows, names, _for_coverage(len(names), k, alpha), n, known, k)


def _frozen_step(rows: DataFrame, names: np.ndarray, gains: Callable, n: int, known: np.ndarray, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, e, c = lists(batch, "at", "eta", "c")
            g = gains(at, e, c * 1.0, 1.0, n, known)
            own = largest(g, size, k)
            row = np.repeat(np.arange(len(size)), size)[own]
            yield pa.RecordBatch.from_arrays([batch.column("instance_id").take(pa.array(row)), pa.array(names[at[own]].astype(np.int32)), pa.array(g[own])], names=["instance_id", "label_id", "gain"])

    return rows.mapInArrow(run, f"instance_id {rows.schema['instance_id'].dataType.simpleString()}, label_id int, gain double")


def minibatch(eta: DataFrame, instances: DataFrame, labels: DataFrame, metric: Metric, k: int, *, slices: int = 10, max_iters: int = 100, tolerance: float = 1e-6, init: str | DataFrame = "top", seed: int = 0, maximize: bool = True, deal: Callable[[int], Column] | None = None) -> tuple[DataFrame, list[float]]:
    """(y_pred, utilities): the expected metric, slice by slice; with init greedy a slice sees only those before it in the first sweep.

    eta is a table of cells or of packed rows (`packed.cells_in_rows`). `deal` gives the slice (0 to slices - 1) of an
    instance in each sweep, by default a hash with the seed and the sweep.
    """
    names, deal, scratch = label_ids(labels), deal or dealt(seed, slices), Scratch(eta.sparkSession)
    start = scratch.save(start_rows(eta, names, k, init, seed).withColumn("part", deal(0)), by=("part",))
    missing = instances.join(start.select("instance_id"), "instance_id", "left_anti").count()
    return _sweeps(
        scratch, start, names, k, 3, lambda e, c: (e * c, c.astype(float), e), expected_gains(metric, names, missing),
        lambda c, n: metric.value(*(x / (n + missing) for x in _entries(c, n + missing)), names),
        slices=slices, max_iters=max_iters, tolerance=tolerance, seen=not (isinstance(init, str) and init == "greedy"), deal=deal, maximize=maximize,
    )


def _log_miss(e: np.ndarray) -> np.ndarray:
    return np.log1p(-np.minimum(e, 1 - 1e-12))


def _for_coverage(m: int, k: int, alpha: float) -> Callable[..., np.ndarray]:
    """The gain of each cell (at, eta, c) for coverage of m labels, at sums of the chosen cells' log_miss."""

    def gains(at: np.ndarray, e: np.ndarray, c: np.ndarray, inside: float, n: int, known: np.ndarray) -> np.ndarray:
        others = known[0][at] - np.where(c > 0, _log_miss(e), 0.0) * inside
        return alpha / m * e * np.exp(others) + (1 - alpha) * e / float(n * k)

    return gains


def coverage(eta: DataFrame, labels: DataFrame, k: int, *, alpha: float = 1.0, slices: int = 10, max_iters: int = 100, tolerance: float = 1e-6, init: str | DataFrame = "top", seed: int = 0, deal: Callable[[int], Column] | None = None) -> tuple[DataFrame, list[float]]:
    """(y_pred, utilities) for alpha * (1 - mean over labels of prod (1 - eta * chosen)) + (1 - alpha) * expected precision at k.

    The chance that no row hits a label is kept as a sum of logarithms; a score of 1 counts as 1 - 1e-12.
    """
    if k <= 0:
        raise ValueError("k has to be positive")
    names, deal, scratch = label_ids(labels), deal or dealt(seed, slices), Scratch(eta.sparkSession)
    start = scratch.save(start_rows(eta, names, k, init, seed).withColumn("part", deal(0)), by=("part",))
    return _sweeps(
        scratch, start, names, k, 2, lambda e, c: (np.where(c, _log_miss(e), 0.0), e * c), _for_coverage(len(names), k, alpha), lambda c, n: coverage_utility(c[0], c[1], n, k, alpha),
        slices=slices, max_iters=max_iters, tolerance=tolerance, seen=not (isinstance(init, str) and init == "greedy"), deal=deal, maximize=True,
    )


def coverage_utility(log_fail: np.ndarray, tp: np.ndarray, n: int, k: int, alpha: float = 1.0) -> float:
    """alpha * (share of labels expected to be hit) + (1 - alpha) * expected precision at k."""
    return float(alpha * (1 - np.exp(log_fail).mean()) + (1 - alpha) * tp.sum() / (n * k))


def exact(eta: DataFrame, labels: DataFrame, metric: Metric, k: int, *, max_iters: int = 100, tolerance: float = 1e-6, init: str | DataFrame = "top", seed: int = 0, most_cells: int = 20_000_000) -> DataFrame:
    """y_pred by the sequential algorithm, row after row in one task, for sets of at most `most_cells` scores; larger ones go slice by slice."""
    if (eta.agg(F.sum(F.size("cells"))).first()[0] or 0 if "cells" in eta.columns else eta.count()) > most_cells:
        return minibatch(eta, eta.select("instance_id").distinct(), labels, metric, k, max_iters=max_iters, tolerance=tolerance, init=init, seed=seed)[0]
    names, greedy = label_ids(labels).tolist(), isinstance(init, str) and init == "greedy"
    eta = eta.select("instance_id", F.inline("cells")) if "cells" in eta.columns else eta
    rows = packed(eta, np.array(names), c=initial(eta, k, init, seed))

    def run(t: pa.Table) -> pa.Table:
        order = np.argsort(t["instance_id"].to_numpy())
        t = t.take(pa.array(order))
        cells = t["cells"].combine_chunks()
        cut = cells.offsets.to_numpy()[1:-1] - cells.offsets[0].as_py()
        index, score, start = (np.split(cells.flatten().field(x).to_numpy(zero_copy_only=False), cut) for x in ("at", "eta", "c"))
        n, m = len(index), len(names)
        total, ids = np.zeros(m), np.array(names)
        for i, e in zip(index, score, strict=True):
            total[i] += 0 if greedy else e
        top = lambda g: np.sort(np.lexsort((np.arange(len(g)), -g))[:k]) if k else np.flatnonzero(g >= 0)
        chosen = [np.flatnonzero(c > 0) for c in start]
        rng, last, seen = np.random.default_rng(seed), -np.inf, 0 if greedy else n
        for sweep in range(max_iters):
            tp, p = np.zeros(m), np.zeros(m)
            for i, e, c in zip(index, score, chosen, strict=True):
                tp[i[c]] += e[c]
                p[i[c]] += 1
            for r in rng.permutation(n):
                i, e, c = index[r], score[r], chosen[r]
                if greedy and not sweep:  # only rows before this one count
                    total[i] += e
                    seen += 1
                tp[i[c]] -= e[c]
                p[i[c]] -= 1
                t0, f0 = np.maximum(tp[i], 0), np.maximum(p[i] - tp[i], 0)
                fn0 = np.maximum(total[i] - e - t0, 0)
                tn0 = np.maximum(seen - 1 - t0 - f0 - fn0, 0)
                g = metric.at(*(x / seen for x in (t0 + e, f0 + 1 - e, fn0, tn0)), ids[i]) - metric.at(*(x / seen for x in (t0, f0, fn0 + e, tn0 + 1 - e)), ids[i])
                if metric.mix != 1:
                    g = metric.mix / m * g + (1 - metric.mix) * e / seen / metric.k
                chosen[r] = c = top(g)
                tp[i[c]] += e[c]
                p[i[c]] += 1
            value = metric.value(tp / n, (p - tp) / n, (total - tp) / n, (n - p - total + tp) / n, ids)
            if value - last < tolerance:
                break
            last = value
        own = t["instance_id"].to_numpy()
        out = [(int(own[r]), names[index[r][j]]) for r in range(n) for j in chosen[r]]
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int32()), pa.array([1.0] * len(out))], names=["instance_id", "label_id", "value"])

    return rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "instance_id bigint, label_id int, value double")


def coverage_gains(eta: DataFrame, y_pred: DataFrame, n: int, m: int, k: int, alpha: float = 1.0) -> DataFrame:
    """eta with gains for coverage: alpha / m * eta * (chance that no other row hits the label) + (1 - alpha) * eta / (n k).

    The chance is a product over rows, kept as a sum of logarithms so that each row's own factor can be
    taken off; a score of 1 counts as 1 - 1e-12.
    """
    miss = F.log1p(-F.least(F.col("eta"), F.lit(1 - 1e-12)))
    rows = eta.join(y_pred.withColumnRenamed("value", "chosen"), ["instance_id", "label_id"], "left").withColumn("own", F.when(F.col("chosen") > 0, miss).otherwise(0.0))
    fail = rows.groupBy("label_id").agg(F.sum("own").alias("log_fail"))
    return rows.join(F.broadcast(fail), "label_id").withColumn("gain", alpha / m * F.col("eta") * F.exp(F.col("log_fail") - F.col("own")) + (1 - alpha) * F.col("eta") / float(n * k))


def coverage_step(eta: DataFrame, y_pred: DataFrame, n: int, m: int, k: int, alpha: float = 1.0) -> DataFrame:
    """One step of all rows for coverage, each against the rest."""
    return best(coverage_gains(eta, y_pred, n, m, k, alpha), k).select("instance_id", "label_id", F.lit(1.0).alias("value"))
