"""Choosing labels for each instance by weighted scores: the k largest gains, or all at a threshold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from labelweave.operators.packed import label_ids
from labelweave.shared import Scratch


def weighted(eta: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """eta with gain = a * eta + b; weights (label_id, a, b) is a row for each label. Absent weights are 1 and 0."""
    if weights is None:
        return eta.withColumn("gain", F.col("eta"))
    a = F.coalesce(F.col("a"), F.lit(1.0)) if "a" in weights.columns else F.lit(1.0)
    b = F.coalesce(F.col("b"), F.lit(0.0)) if "b" in weights.columns else F.lit(0.0)
    return eta.join(weights, "label_id", "left").withColumn("gain", a * F.col("eta") + b).select(*eta.columns, "gain")


def best(gains: DataFrame, k: int, by: str = "gain") -> DataFrame:
    """The k rows with the largest gain of each instance, ties to smaller labels; fewer where there are fewer."""
    rank = F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc(by), "label_id"))
    return gains.withColumn("rank", rank).where(F.col("rank") <= k)


def predict(eta: DataFrame, k: int, *, th: float | DataFrame = 0.0, weights: DataFrame | None = None, keep_scores: bool = False) -> DataFrame:
    """(instance_id, label_id, value): top k by gain, or with k = 0 all labels with gain >= th.

    th is a number or a table (label_id, th). value is 1, or the gain with keep_scores.
    """
    gains = weighted(eta, weights)
    if k > 0:
        chosen = best(gains, k)
    elif isinstance(th, DataFrame):
        chosen = gains.join(th.select("label_id", "th"), "label_id").where("gain >= th")
    else:
        chosen = gains.where(F.col("gain") >= th)
    return chosen.select("instance_id", "label_id", (F.col("gain") if keep_scores else F.lit(1.0)).alias("value"))


def _by_prior(priors: DataFrame, a: Column, b: Column | None = None) -> DataFrame:
    return priors.select("label_id", a.alias("a"), (F.lit(0.0) if b is None else b).alias("b"))


def top_k(eta: DataFrame, k: int, **more) -> DataFrame:
    return predict(eta, k, **more)


def for_instance_precision(eta: DataFrame, k: int, **more) -> DataFrame:
    if k <= 0:
        raise ValueError("k has to be positive")
    return predict(eta, k, **more)


def for_macro_recall(eta: DataFrame, k: int, priors: DataFrame, epsilon: float = 1e-6, **more) -> DataFrame:
    return predict(eta, k, weights=_by_prior(priors, 1 / (F.col("prior") + epsilon)), **more)


def for_macro_balanced_accuracy(eta: DataFrame, k: int, priors: DataFrame, epsilon: float = 1e-6, **more) -> DataFrame:
    """Gain eta / p - (1 - eta) / (1 - p) with p = prior + epsilon; a prior of 1 leaves the second term out."""
    p = F.col("prior") + epsilon
    rest = F.when(p < 1, 1 / (1 - p)).otherwise(0.0)
    return predict(eta, k, weights=_by_prior(priors, 1 / p + rest, -rest), **more)


def log_weighted(eta: DataFrame, k: int, priors: DataFrame, epsilon: float = 1e-9, **more) -> DataFrame:
    return predict(eta, k, weights=_by_prior(priors, -F.log(F.col("prior") + epsilon)), **more)


def power_law_weighted(eta: DataFrame, k: int, priors: DataFrame, beta: float, epsilon: float = 1e-9, **more) -> DataFrame:
    return predict(eta, k, weights=_by_prior(priors, F.pow(F.col("prior") + epsilon, F.lit(-beta))), **more)


def for_propensity_scored_precision(eta: DataFrame, k: int, *, propensities: DataFrame | None = None, inverse: DataFrame | None = None, **more) -> DataFrame:
    """Weights are inverse propensities; a propensity of 0 counts as 1."""
    if (propensities is None) == (inverse is None):
        raise ValueError("give either propensities or inverse propensities")
    if inverse is None:
        weights = propensities.select("label_id", F.when(F.col("propensity") > 0, 1 / F.col("propensity")).otherwise(1.0).alias("a"))
    else:
        weights = inverse.select("label_id", F.col("inverse_propensity").alias("a"))
    return predict(eta, k, weights=weights, **more)


def random_at_k(cells: DataFrame, k: int, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """k of the labels that each instance has in cells, drawn by a hash of both and the seed."""
    drawn = cells.withColumn("draw", F.xxhash64("instance_id", "label_id", F.lit(seed)) if draw is None else draw)
    return best(drawn, k, by="draw").select("instance_id", "label_id", F.lit(1.0).alias("value"))


def random_subset(m: Column | int, k: int, draw: Callable[[Column], Column]) -> Column:
    """k different numbers of 0 .. m - 1 as an array, all m if k is larger; each set is equally likely if draws are uniform.

    draw(j) gives a whole number of at least 0 for each j. For j from m - k on, its rest by j + 1 is taken, or j
    itself if that rest is taken already; a row costs k draws, whatever m is.
    """
    m = F.lit(m).cast("int") if isinstance(m, int) else m.cast("int")

    def add(taken: Column, j: Column) -> Column:
        t = F.pmod(draw(j), (j + 1).cast("bigint")).cast("int")
        return F.array_append(taken, F.when(F.array_contains(taken, t), j).otherwise(t))

    steps = F.when(m > 0, F.sequence(F.greatest(m - k, F.lit(0)), m - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps if k > 0 else F.array().cast("array<int>"), F.array().cast("array<int>"), add)


def random_labels(instances: DataFrame, labels: DataFrame | int, k: int, seed: int = 0, draw: Callable[[Column], Column] | None = None) -> DataFrame:
    """(instance_id, label_id, value): k different labels of all for each instance, uniformly, without a row for each cell.

    labels is a table, or a number m for the labels 0 .. m - 1. By default draws are a hash of instance_id, the step and the seed.
    """
    draw = draw or (lambda j: F.abs(F.xxhash64("instance_id", j, F.lit(seed)) % F.lit(1 << 62)))
    m = labels if isinstance(labels, int) else labels.count()
    picked = instances.select("instance_id", F.explode(random_subset(m, k, draw)).alias("at"))
    if isinstance(labels, int):
        return picked.select("instance_id", F.col("at").alias("label_id"), F.lit(1.0).alias("value"))
    names = labels.sparkSession.createDataFrame([(i, int(j)) for i, j in enumerate(label_ids(labels))], "at int, label_id int")
    return picked.join(F.broadcast(names), "at").select("instance_id", "label_id", F.lit(1.0).alias("value"))  # a row for each label


def prune(cells: DataFrame, threshold: float, k: int) -> DataFrame:
    """Cells of at least the threshold, and each instance's k largest in any case."""
    rank = F.row_number().over(Window.partitionBy("instance_id").orderBy(F.desc("eta"), "label_id"))
    return cells.withColumn("rank", rank).where((F.col("eta") >= threshold) | (F.col("rank") <= k)).drop("rank")


def exactly_k(y: DataFrame, instances: DataFrame, k: int) -> DataFrame:
    """One row: are all values 0 or 1 (binary), and has each instance k ones (at_k)."""
    sums = y.groupBy("instance_id").agg(F.sum("value").alias("s"), F.bool_and(F.col("value").isin(0.0, 1.0)).alias("ok"))
    full = instances.select("instance_id").join(sums, "instance_id", "left")
    return full.agg(F.bool_and(F.coalesce("ok", F.lit(True))).alias("binary"), F.bool_and(F.coalesce("s", F.lit(0.0)) == k).alias("at_k"))


def first_k(cells: DataFrame, k: int) -> DataFrame:
    """The k smallest labels of each instance."""
    return best(cells.withColumn("_gain", -F.col("label_id")), k, by="_gain").select("instance_id", "label_id", F.lit(1.0).alias("value"))


def sampled(eta: DataFrame, seed: int = 0, draw: Column | None = None) -> DataFrame:
    """(instance_id, label_id): labels drawn with their probability eta; draw is uniform on [0, 1), by default from a hash."""
    u = (F.pmod(F.xxhash64("instance_id", "label_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)) if draw is None else draw
    return eta.where(F.col("eta") >= u).select("instance_id", "label_id")


def argmax_accuracy(grid: DataFrame) -> DataFrame:
    """One row with `value`: the share of instances whose label with the largest score is right."""
    return best(grid, 1, by="eta").agg(F.avg(F.col("y").cast("double")).alias("value"))


def tune_thresholds(grid: DataFrame, metric: str = "f1", *, buckets: int = 1024) -> DataFrame:
    """(label_id, th, value): for each label the threshold with the best F1 or min(tp, tn) over grid (label_id, eta, y).

    Running sums over scores from the largest on give the counts at every cut; a cut stands half-way to the
    next smaller score, after the last score 1e-6 below it. Ties go to the larger score. Scores fall into
    `buckets` ranges of width 1 / buckets; sums run over ranges first and within each range then, so no task
    sorts all scores of a label.
    """
    at = grid.groupBy("label_id", "eta").agg(F.sum("y").alias("y"), F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("eta") * buckets))
    ranges = at.groupBy("label_id", "bucket").agg(F.sum("y").alias("y"), F.sum("n").alias("n"), F.max("eta").alias("top"))
    return _best_cuts(at, _so_far(ranges, "label_id"), metric, "label_id")


def tune_by_period(cells: DataFrame, periods: int, metric: str = "f1", *, buckets: int = 1024) -> DataFrame:
    """(period, label_id, th, value): for periods 1 to periods - 1 what `tune_thresholds` gives on cells (period, label_id, eta, y) of all earlier periods.

    Cells are counted by ranges of scores first. No cut within a range gives more than if all its positive cells came
    first, and the cut at a range's end is one that there is; so few ranges are left in which a best cut may lie, and
    only their cells are counted score by score. y is from 0 to 1. cells are read twice.
    """
    scratch = Scratch(cells.sparkSession)
    keys, named = ("period", "label_id"), cells.where(F.col("period") < periods - 1).select(F.col("period").alias("since"), "label_id", "eta", "y", F.floor(F.col("eta") * buckets).alias("bucket"))
    own = named.groupBy("since", "label_id", "bucket").agg(F.coalesce(F.sum("y"), F.lit(0)).alias("y"), F.count("*").alias("n"), F.max("eta").alias("top"))
    later = F.explode(F.sequence(F.col("since") + 1, F.lit(periods - 1))).alias("period")  # a row for each period, label and range
    ranges = own.select(later, "label_id", "bucket", "y", "n", "top").groupBy(*keys, "bucket").agg(F.sum("y").alias("y"), F.sum("n").alias("n"), F.max("top").alias("top"))
    tp, before = F.col("y_before") + F.col("y"), F.col("n_before")
    ranges = _so_far(ranges, *keys, more=("y", "n")).withColumn("most", _cut_value(metric, tp, F.greatest(before + F.col("y"), F.lit(1)))).withColumn("reached", _cut_value(metric, tp, before + F.col("n")))
    ranges = ranges.withColumn("best", F.max("reached").over(Window.partitionBy(*keys)))
    # where nothing can be right, the largest score wins the tie
    kept = scratch.save(ranges.where((F.col("most") >= F.col("best") * (1 - 1e-9) - 1e-9) & ((F.col("most") > 0) | (before == 0))).drop("y", "n", "most", "reached", "best"))
    at = named.join(kept.select(*keys, "bucket"), ["label_id", "bucket"]).where("since < period").groupBy(*keys, "bucket", "eta").agg(F.sum("y").alias("y"), F.count("*").alias("n"))
    return _best_cuts(at, kept, metric, *keys)


def _so_far(ranges: DataFrame, *keys: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Ranges (keys, bucket, y, n, top) with the sums over larger scores, the next smaller score and the sums over all."""
    down, every = Window.partitionBy(*keys).orderBy(F.desc("bucket")), Window.partitionBy(*keys)
    before = down.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return ranges.select(*keys, "bucket", *more, zero(F.sum("y").over(before)).alias("y_before"), zero(F.sum("n").over(before)).alias("n_before"), F.lead("top").over(down).alias("below"), F.sum("y").over(every).alias("positive"), F.sum("n").over(every).alias("all"))


def _cut_value(metric: str, tp: Column, predicted: Column) -> Column:
    positive = F.col("positive")
    return {"f1": 2.0 * tp / (predicted + positive), "min_tp_tn": F.least(tp, F.col("all") - predicted - positive + tp).cast("double")}[metric]


def _best_cuts(at: DataFrame, ranges: DataFrame, metric: str, *keys: str) -> DataFrame:
    """(keys, th, value): the best cuts among scores `at` (keys, bucket, eta, y, n) within the given ranges."""
    within = Window.partitionBy(*keys, "bucket").orderBy(F.desc("eta"))
    run = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cuts = at.select(*keys, "bucket", "eta", F.lead("eta").over(within).alias("next"), F.sum("y").over(run).alias("y"), F.sum("n").over(run).alias("n")).join(ranges, [*keys, "bucket"])
    value, next_ = _cut_value(metric, F.col("y") + F.col("y_before"), F.col("n") + F.col("n_before")), F.coalesce("next", "below")
    cuts = cuts.select(*keys, "eta", F.round(value, 12).alias("value"), F.when(next_.isNull(), F.col("eta") - 1e-6).otherwise((F.col("eta") + next_) / 2).alias("th"))
    top = cuts.groupBy(*keys).agg(F.max_by(F.struct("th", "value"), F.struct("value", "eta")).alias("top"))
    return top.select(*keys, "top.th", "top.value")
