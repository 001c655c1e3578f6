"""Streams that stop and start again, exact replay by label, metrics over time."""

import os
import shutil

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.functions import metrics as M
from labelweave.operators import named, select
from labelweave.operators.batches import squeezed, unsqueezed
from labelweave.plans.queries import queries
from labelweave.streaming import history, online
from labelweave.streaming.by_label import Rule, arrival, replay_by_label
from labelweave.streaming.state import LearnerStore, batches_to


def cells_of(rng, n, m, share=1.0):
    eta = rng.random((n, m)) * np.linspace(1, 0.2, m)
    return [(i, j, float(eta[i, j]), int(rng.random() < eta[i, j])) for i in range(n) for j in range(m) if rng.random() < share]


SCHEMA = "instance_id bigint, label_id int, eta double, y int"


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(j,) for j in range(6)], "label_id int")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Four files of 60 instances each."""
    folder = tmp_path_factory.mktemp("parts")
    rows = cells_of(np.random.default_rng(5), 240, 6)
    for k in range(4):
        spark.createDataFrame([r for r in rows if r[0] // 60 == k], SCHEMA).coalesce(1).write.parquet(str(folder / str(k)))
    return folder


def give(parts, source, ks):
    os.makedirs(source, exist_ok=True)
    for k in ks:
        name = next(x for x in os.listdir(parts / str(k)) if x.endswith(".parquet"))
        shutil.copy(parts / str(k) / name, f"{source}/{k}.parquet")
        os.utime(f"{source}/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))


def play(spark, labels, tmp, source, kind):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query, learner = online.start(stream, labels, M.Metric("f1"), 2, batches_to(f"{tmp}/out"), f"{tmp}/state", kind=kind)
    query.awaitTermination()
    return learner


def rows_of(spark, tmp):
    return sorted((r.batch, r.instance_id, r.label_id) for r in spark.read.parquet(f"{tmp}/out").collect())


@pytest.mark.parametrize("kind", ["gradient", "greedy"])
def test_stream_goes_on_after_a_restart_and_after_a_crash(spark, labels, parts, tmp_path, kind):
    once = str(tmp_path / "once")
    give(parts, f"{once}/in", range(4))
    whole = play(spark, labels, once, f"{once}/in", kind)
    want = rows_of(spark, once)
    assert whole.state.n == 240 and len(want) == 480 and {b for b, _, _ in want} == {0, 1, 2, 3}
    cut = str(tmp_path / "cut")
    give(parts, f"{cut}/in", (0, 1))
    play(spark, labels, cut, f"{cut}/in", kind)
    # a crash after the second batch's output and state were written, but before the stream knew it
    os.remove(f"{cut}/state/commits/1")
    if os.path.exists(f"{cut}/state/commits/.1.crc"):
        os.remove(f"{cut}/state/commits/.1.crc")
    give(parts, f"{cut}/in", (2, 3))
    again = play(spark, labels, cut, f"{cut}/in", kind)
    assert rows_of(spark, cut) == want
    assert again.state.n == 240 and (again.state.c == whole.state.c).all()
    # a state that was cut off in writing does not count
    store = LearnerStore(spark, f"{cut}/state/learner")
    assert store.versions() == [2, 3]
    os.remove(f"{cut}/state/learner/3/_SUCCESS")
    assert store.before(4)[0] == 2 and store.before(2) is None


def test_new_labels_begin_anew(spark, tmp_path):
    store = LearnerStore(spark, str(tmp_path / "s"))
    few, more = (spark.createDataFrame([(j,) for j in ids], "label_id int") for ids in ((1, 2), (1, 2, 3)))
    rows = spark.createDataFrame([(0, 1, 0.9, 1), (0, 2, 0.1, 0), (1, 1, 0.8, 0), (1, 2, 0.7, 1)], SCHEMA)
    online.BatchLearner(few, M.Metric("f1"), 1, store=store).step(rows, 0, lambda d, n: d.collect())
    learner = online.BatchLearner(more, M.Metric("f1"), 1, store=store)
    learner.step(rows.limit(0), 1, lambda d, n: d.collect())
    assert learner.state.n == 2 and learner.state.c[:, 2].round(3).tolist() == [0, 0, 0, 2] and np.allclose(learner.state.c.sum(axis=0), 2, atol=1e-4)


def sequential(rows, kind, metric, m, k=0):
    learner, out = online.Learner(kind, metric, k, m), []
    for i in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == i]
        index = np.array([r[1] for r in own])
        chosen = learner.choose(index, np.array([r[2] for r in own]))
        learner.update(index, np.array([r[3] for r in own], float), chosen)
        out += [(i, int(index[j])) for j in chosen]
    return sorted(out)


@pytest.mark.parametrize(("kind", "metric"), [("default", "f1"), ("thresholds", "f1"), ("gradient", "f1"), ("gradient", "balanced_accuracy"), ("gradient", "gmean"), ("greedy", "f1"), ("greedy", "jaccard"), ("greedy", "balanced_accuracy")])
def test_labels_apart_give_the_sequential_rows(spark, kind, metric):
    """Sparse rows, several blocks and batches, a label in one task and many labels in few tasks."""
    rows = cells_of(np.random.default_rng(7), 300, 6, 0.7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = sequential(rows, kind, M.Metric(metric), 6)
    for block, partitions in ((16, 2), (4096, 6)):
        found = replay_by_label(df, kind, M.Metric(metric), block=block, partitions=partitions)
        assert sorted((r.instance_id, r.label_id) for r in found.collect()) == want and 0 < len(want) < len(rows)


def test_decisions_that_depend_on_all_before():
    """Scores at the threshold itself, where a decision changes the next one; many passes, same rows."""
    rng = np.random.default_rng(1)
    eta, y = rng.random(2000) * 0.1 + 0.3, (rng.random(2000) < 0.35).astype(float)
    rule, c, want = Rule("thresholds", M.Metric("f1"), 1e-6), np.full(3, 1e-6), []
    for e, t in zip(eta, y, strict=True):
        p = float(e >= c[0] / (2 * c[0] + c[1] + c[2]))
        c += [t * p, (1 - t) * p, t * (1 - p)]
        want.append(bool(p))
    state = np.array([1e-6, 1e-6, 1e-6, 0.0])
    assert rule.settle(state, np.arange(2000), eta, y, 0).tolist() == want and (state[:3] == c).all()
    assert len(set(want)) == 2


def test_replay_refuses_what_couples_labels(spark):
    with pytest.raises(ValueError):
        replay_by_label(spark.createDataFrame([], SCHEMA), "gradient", M.Metric("f1", "micro"))
    assert replay_by_label(spark.createDataFrame([], SCHEMA), "gradient", M.Metric("f1")).count() == 0


def test_arrival_places(spark):
    rows = spark.createDataFrame([(i, j, 0.1, 0, 1000 - i) for i in range(0, 200, 3) for j in (1, 2)], SCHEMA + ", time int").repartition(7)
    places = {r.instance_id: r.pos for r in arrival(rows, "time").collect()}
    assert places == {i: k for k, i in enumerate(sorted(range(0, 200, 3), reverse=True))}
    plan = replay_by_label(rows, "thresholds", M.Metric("f1"), order="time", partitions=3)
    assert plan.rdd.getNumPartitions() == 3


def test_metric_over_time(spark, labels):
    rng = np.random.default_rng(3)
    y, p = (rng.random((2, 95, 6)) < 0.3).astype(float)
    rows = [(i * 3, j, float(y[i, j]), float(p[i, j])) for i in range(95) for j in range(6) if y[i, j] or p[i, j]]
    instances = spark.createDataFrame([(i * 3,) for i in range(95)], "instance_id bigint")
    for metric in (M.Metric("f1"), M.Metric("balanced_accuracy", "micro"), M.Metric("recall", mix=0.4, k=2)):
        found = {r.position: (r.n, r.value) for r in history.prequential_metric(spark.createDataFrame(rows, "instance_id bigint, label_id int, y double, p double"), labels, metric, instances=instances, every=20, wide=3).collect()}
        assert set(found) == set(range(15))
        for position, (n, value) in found.items():
            own = [i for i in range(95) if i * 3 // 20 <= position]
            a, b = y[own], p[own]
            want = metric.value(*((x.sum(axis=0) / len(own)) for x in (a * b, (1 - a) * b, a * (1 - b), (1 - a) * (1 - b))), np.arange(6))
            assert n == len(own) and value == pytest.approx(want, abs=1e-9)


WRAPPERS = [f"{method}_{average}_{metric}" for method in ("omma", "greedy") for average in ("macro", "micro") for metric in named.MACRO] + ["ofo_macro_f1", "ofo_micro_f1", "default"]


@pytest.mark.parametrize("name", WRAPPERS)
def test_learners_by_name(spark, labels, name):
    """All named learners, with labels and with scores in their place (etu), choosing two labels or by a threshold."""
    rows = cells_of(np.random.default_rng(11), 40, 6)
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    kind = next((k for m, k in (("omma", "gradient"), ("greedy", "greedy"), ("ofo", "thresholds")) if name.startswith(m)), "default")
    metric = named.objective(name.split("_", 1)[1] if "_" in name else "macro_f1", 2)
    for k, etu in ((2, False), (0, True)):
        found = sorted((r.instance_id, r.label_id) for r in online.learn_online(name, df, labels, k, etu=etu).collect())
        seen = [(i, j, e, e if etu else y) for i, j, e, y in rows]
        assert found == sequential(seen, kind, metric, 6, k)


def test_history_of_nothing(spark, labels):
    none = spark.createDataFrame([], "instance_id bigint, label_id int, y double, p double")
    assert history.prequential_metric(none, labels, M.Metric("f1")).count() == 0
    only = spark.createDataFrame([(5,)], "instance_id bigint")
    assert [tuple(r) for r in history.prequential_metric(none, labels, M.Metric("f1"), instances=only, every=1).select("position", "n", F.round("value", 6)).collect()] == [(5, 1, 0.0)]


@pytest.mark.parametrize("metric", ["f1", "min_tp_tn"])
def test_thresholds_of_all_periods_at_once(spark, labels, metric):
    """Against a search on all earlier rows in each period; ties, a label that is never right, one that begins late."""
    rng = np.random.default_rng(19)
    eta = np.where(rng.random((400, 6)) < 0.5, rng.random((400, 6)), rng.integers(0, 9, (400, 6)) / 8)
    cells = [(i + 7, j, float(eta[i, j]), int(j != 2 and rng.random() < eta[i, j])) for i in range(400) for j in range(6) if j != 4 or i > 200]
    df = spark.createDataFrame(cells, SCHEMA)
    starts = [7, 27, 37, 52, 74, 108, 158, 234, 348]
    period = lambda i: sum(i >= x for x in starts) - 1
    found = {(r.period, r.label_id): (r.th, r.value) for r in select.tune_by_period(spark.createDataFrame([(period(i), *c) for i, *c in cells], "period int, label_id int, eta double, y int"), 9, metric).collect()}
    want, chosen = {}, {(i, j) for i, j, e, _ in cells if period(i) == 0 and e >= 0.5}
    for p in range(1, 9):
        own = {r.label_id: (r.th, r.value) for r in select.tune_thresholds(df.where(F.col("instance_id") < starts[p]), metric).collect()}
        want |= {(p, j): x for j, x in own.items()}
        chosen |= {(i, j) for i, j, e, _ in cells if period(i) == p and j in own and e >= own[j][0]}
    assert found == want and (3, 4) not in want and want[8, 2][1] == 0
    packed = online.cells_of(df)
    for rows in (df, packed):
        replayed = online.replay_retuned(rows, labels, "thresholds", M.Metric(metric), 0, first=20)
        assert replayed._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 1  # the rows are not put together anew in each period
        assert sorted((r.instance_id, r.label_id) for r in replayed.collect()) == sorted(chosen)


def test_few_scores_are_counted_one_by_one(spark, tmp_path):
    """Where scores are continuous, few ranges of them can hold a best cut."""
    rng = np.random.default_rng(23)
    eta = rng.random(60_000)
    df = spark.createDataFrame([(int(i >= 20_000) + int(i >= 40_000), 1, float(e), int(rng.random() < e)) for i, e in enumerate(eta)], "period int, label_id int, eta double, y int")
    found = select.tune_by_period(df, 3)
    from labelweave.shared import Scratch

    kept = spark.read.parquet(Scratch.made[-1].kept[-1]).where("period = 2")
    assert 0 < kept.count() < 200 and found.where("period = 2").first().value == select.tune_thresholds(df.where("period < 2")).first().value


@pytest.mark.parametrize("kind", ["gradient", "thresholds"])
def test_columns_of_labels_in_pieces(spark, kind):
    """Packed rows, with and without their places, lying in any order, identifiers that are no numbers; many small pieces."""
    rows = cells_of(np.random.default_rng(29), 300, 6, 0.7)
    want = sequential(rows, kind, M.Metric("f1"), 6)
    packed = online.cells_of(spark.createDataFrame(rows, SCHEMA)).cache()
    places = {i: k for k, i in enumerate(sorted({r[0] for r in rows}))}
    place = F.create_map(*[F.lit(x) for pair in places.items() for x in pair])[F.col("instance_id")].cast("bigint")
    mixed = packed.withColumn("pos", place).repartition(3, F.xxhash64("instance_id"))
    for df, held in ((packed, 50), (packed, 10_000), (mixed, 50), (mixed.orderBy("pos").coalesce(1), 1)):
        found = replay_by_label(df, kind, M.Metric("f1"), partitions=2, block=16, held=held)
        assert sorted((r.instance_id, r.label_id) for r in found.collect()) == want
    texts = packed.withColumn("instance_id", F.format_string("%05d", "instance_id"))
    assert sorted((int(r.instance_id), r.label_id) for r in replay_by_label(texts, kind, M.Metric("f1"), held=200).collect()) == want


def test_columns_are_squeezed():
    rng = np.random.default_rng(31)
    few, y, gap, any_ = rng.integers(0, 20_000, 80_000) / 20_000, (rng.random(80_000) < 0.2).astype(float), np.ones(80_000, np.int64), rng.random(80_000)
    few[3], ids = np.nan, pa.array([None, "a", "b"])
    data = squeezed(few, y, gap)
    assert len(data) < 5 * len(few) and len(squeezed(any_)) < 8 * len(any_)
    for found, x in zip(unsqueezed(data) + unsqueezed(squeezed(any_, gap[:0])), (few, y, gap, any_, gap[:0]), strict=True):
        assert found.dtype == x.dtype and np.array_equal(found, x, equal_nan=True)
    assert unsqueezed(squeezed(ids, gap))[0].equals(ids)


@pytest.mark.parametrize("name", ["online_gradient_by_label", "online_thresholds"])
def test_cells_are_made_after_sorting(spark, small, name):
    """What is sorted and written are the orders with their own labels, not a cell for each label."""
    from labelweave.shared import Scratch

    made = len(Scratch.made)
    found = queries()[name](spark, small)
    (written,) = [path for x in Scratch.made[made:] for path in x.kept]
    table = spark.read.parquet(written)
    assert table.columns == ["instance_id", "own", "_place"] and table.count() == spark.read.parquet(f"{small}/orders.parquet").count()
    assert found.count()
