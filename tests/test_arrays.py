"""Array files: all layouts and kinds of numbers, ranges of rows, what is not safe to read."""

import io
import pickle
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.sources import arrays, text


@pytest.fixture(scope="module", autouse=True)
def formats(spark):
    arrays.register(spark)


def values(df):
    return [r["values"] for r in df.orderBy("instance_id").collect()]


@pytest.mark.parametrize("dtype", ["?", "i1", "<i2", ">i4", "i8", "u1", "u2", "u4", "f2", "<f4", ">f8"])
@pytest.mark.parametrize("order", ["C", "F"])
def test_npy_kinds(spark, tmp_path, dtype, order):
    x = np.asarray(np.arange(35).reshape(7, 5) % 2 if dtype == "?" else np.arange(35).reshape(7, 5), dtype=dtype, order=order)
    np.save(tmp_path / "x.npy", x)
    df = spark.read.format("npy").option("partitionBytes", 2 * 5 * x.itemsize).option("batchCells", 5).load(str(tmp_path / "x.npy"))
    assert values(df) == x.tolist() and df.rdd.getNumPartitions() == 4


def test_npy_of_one_dimension_and_folders(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        np.save(folder / f"{k}.npy", np.arange(k * 10, k * 10 + 4 + k))
    df = spark.read.format("npy").load(str(folder))
    assert df.dtypes == [("instance_id", "bigint"), ("value", "bigint")]
    assert [r.value for r in df.orderBy("instance_id").collect()] == [*range(4), *range(10, 15), *range(20, 26)]
    assert [r.instance_id for r in df.where("instance_id >= 3 and instance_id < 6").orderBy("instance_id").collect()] == [3, 4, 5]
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    assert spark.read.format("npy").load(str(tmp_path / "none.npy")).count() == 0


def test_filters_prune_ranges(tmp_path):
    np.save(tmp_path / "x.npy", np.arange(1000.0))
    reader = arrays.NpyReader({"path": str(tmp_path / "x.npy"), "partitionBytes": 80})
    assert len(reader.partitions()) == 100
    list(reader.pushFilters([arrays.GreaterThanOrEqual(("instance_id",), 500), arrays.LessThan(("instance_id",), 515)]))
    assert [(p.first, p.n) for p in reader.partitions()] == [(500, 10), (510, 5)]


def test_pair_of_labels_and_scores(spark, tmp_path):
    rng = np.random.default_rng(1)
    labels, scores = rng.permuted(np.tile(np.arange(9), (20, 1)), axis=1)[:, :4], rng.random((20, 4), np.float32)
    np.save(tmp_path / "a-labels.npy", labels), np.save(tmp_path / "a-scores.npy", scores)
    df = spark.read.format("npy").option("scores", str(tmp_path / "a-scores.npy")).option("partitionBytes", 200).load(str(tmp_path / "a-labels.npy"))
    assert sorted(map(tuple, df.collect())) == sorted((i, int(j), float(s)) for i in range(20) for j, s in zip(labels[i], scores[i], strict=True))


def test_lists_of_labels_and_nothing_else(spark, tmp_path):
    lists = np.array([[1, 5], [], [7], None], dtype=object)
    np.save(tmp_path / "lists.npy", lists, allow_pickle=True)
    rows = spark.read.format("npy").load(str(tmp_path / "lists.npy"))
    assert values(rows) == [[1, 5], [], [7], None]
    assert sorted(map(tuple, text.labels_from_arrays(rows, "values").collect())) == [(0, 1, 1.0), (0, 5, 1.0), (2, 7, 1.0)]

    class Bad:
        def __reduce__(self):
            return print, ("called",)

    raw = io.BytesIO()
    np.lib.format.write_array_header_1_0(raw, {"descr": "|O", "fortran_order": False, "shape": (1,)})
    (tmp_path / "bad.npy").write_bytes(raw.getvalue() + pickle.dumps(Bad()))
    with pytest.raises(Exception, match="does not belong"):
        spark.read.format("npy").load(str(tmp_path / "bad.npy")).collect()


def sparse(rng, n, m):
    dense = np.where(rng.random((n, m)) < 0.2, rng.random((n, m)), 0)
    dense[::7] = 0
    at = [np.flatnonzero(r) for r in dense]
    return dense, {"indices": np.concatenate(at).astype(np.int32), "indptr": np.cumsum([0, *map(len, at)]).astype(np.int32), "format": np.array(b"csr"), "shape": np.array([n, m]), "data": np.concatenate([r[i] for r, i in zip(dense, at, strict=True)])}


@pytest.mark.parametrize("packed", [False, True])
def test_npz(spark, tmp_path, packed):
    """As the usual library writes it: members stored, or compressed."""
    dense, members = sparse(np.random.default_rng(2), 50, 30)
    (np.savez_compressed if packed else np.savez)(tmp_path / "m.npz", **members)
    want = sorted((i, j, dense[i, j]) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(dense)), strict=True))
    for options in ({}, {"batchCells": 7}, {"partitions": 6, "batchCells": 11}, {"partitionBytes": 500}):
        df = spark.read.format("npz").options(**options).load(str(tmp_path / "m.npz"))
        assert df.dtypes == [("instance_id", "bigint"), ("label_id", "int"), ("value", "double")]
        assert sorted(map(tuple, df.collect())) == want
    assert spark.read.format("npz").option("partitionBytes", 500).load(str(tmp_path / "m.npz")).rdd.getNumPartitions() == (1 if packed else -(-len(want) * 12 // 500))
    np.savez(tmp_path / "other.npz", **(members | {"format": np.array(b"csc")}))
    with pytest.raises(Exception, match="compressed sparse rows"):
        spark.read.format("npz").load(str(tmp_path / "other.npz")).collect()


def test_what_is_written_is_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    dense, _ = sparse(rng, 53, 12)
    cells = spark.createDataFrame([(i, j, float(dense[i, j])) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(dense)), strict=True)], "instance_id bigint, label_id int, value double").repartition(5)
    path = str(tmp_path / "cells")
    for block in (1000, 10, 1):
        arrays.write_npz(cells, path, 53, 12, block_rows=block)
        assert len(arrays.files_of(path, ".npz")) == -(-53 // block)
        assert sorted(map(tuple, spark.read.format("npz").load(path).collect())) == sorted(map(tuple, cells.collect()))
    with zipfile.ZipFile(arrays.files_of(path, ".npz")[8]) as z:  # any reader of such files knows the members
        own = {k.filename: np.load(io.BytesIO(z.read(k))) for k in z.infolist()}
    assert own["shape.npy"].tolist() == [1, 12] and own["format.npy"] == b"csr" and own["indptr.npy"].tolist()[-1] == np.count_nonzero(dense[8])
    rows = spark.createDataFrame([(i, [float(v) for v in dense[i]]) for i in range(53)], "instance_id bigint, values array<double>").repartition(4)
    arrays.write_npy(rows, str(tmp_path / "rows"), 53, block_rows=20)
    assert values(spark.read.format("npy").load(str(tmp_path / "rows"))) == dense.tolist()
    assert (np.load(arrays.files_of(str(tmp_path / "rows"), ".npy")[2]) == dense[40:]).all()
    with pytest.raises(Exception, match="not there once each"):
        arrays.write_npy(rows.where(F.col("instance_id") != 30), str(tmp_path / "bad"), 53, block_rows=20)
    assert not arrays.files_of(str(tmp_path / "bad"), "")


def test_text_sources(spark, tmp_path):
    """Lines of features with labels, and a table that is made once."""
    (tmp_path / "x.svm").write_text("1,3 0:0.5 7:2\n# only a comment\n 2:1.5 # no label\n4\n")
    y, x = text.read_libsvm(spark, str(tmp_path / "x.svm"))
    order = {i: k for k, i in enumerate(sorted({r.instance_id for r in y.collect()} | {r.instance_id for r in x.collect()}))}
    assert sorted((order[r.instance_id], r.label_id) for r in y.collect()) == [(0, 1), (0, 3), (2, 4)]
    assert sorted((order[r.instance_id], r.feature_id, r.value) for r in x.collect()) == [(0, 0, 0.5), (0, 7, 2.0), (1, 2, 1.5)]
    made = []

    def create():
        made.append(1)
        return spark.range(3)

    for _ in range(2):
        assert text.load_or_create(spark, str(tmp_path / "once"), create).count() == 3
    assert made == [1]
