"""Stored tables and models, streams that are taken up again, and training by summed gradients."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark import scratch
from shelfmark.operators import network, prefs
from shelfmark.queries.learning import training_rows
from shelfmark.sources import catalog, labels, models
from shelfmark.streaming.changes import detect_changes

LABELS = "file_id long, task_id long, user_label string, ai_prediction string, labeled_at timestamp_ntz, label_source string"
NEW = "file_id long, task_id long, user_label string, labeled_at timestamp_ntz"


def _labels(spark, rows, schema):
    return spark.createDataFrame(rows, re.sub("timestamp_ntz", "string", schema)).withColumn("labeled_at", F.col("labeled_at").cast("timestamp_ntz"))


def test_labels_are_merged_part_by_part(spark, tmp_path):
    path = str(tmp_path / "labels")
    old = [(i, 1, "keep" if i % 2 else None, "delete", "2024-01-01", "manual") for i in range(200)]
    labels.write_labels(_labels(spark, old, LABELS), path, 16)
    stamps = {p: p.stat().st_mtime_ns for p in (tmp_path / "labels").rglob("*.parquet")}
    first = _labels(spark, [(3, 1, "delete", "2024-02-01"), (900, 1, "keep", "2024-02-01"), (3, 1, "keep", "2024-01-15")], NEW)
    plan = labels.touched(spark, path, first, 16)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan)
    labels.merge_labels(spark, path, first, prefs.upsert_labels, 16)
    kept = [p for p in (tmp_path / "labels").rglob("*.parquet") if stamps.get(p) == p.stat().st_mtime_ns]
    assert len({p.parent for p in kept}) >= 14  # two folders at most were written anew
    once = sorted(map(tuple, labels.read_labels(spark, path).collect()), key=str)
    got = {x[0]: x[2] for x in once}
    assert got[3] == "delete" and got[900] == "keep" and got[5] == "keep" and len(once) == 201
    second = _labels(spark, [(3, 1, "keep", "2024-03-01")], NEW)
    labels.merge_labels(spark, path, second, prefs.upsert_labels, 16)
    labels.merge_labels(spark, path, first, prefs.upsert_labels, 16)  # comes late and again: older than what is there
    again = {x.file_id: x.user_label for x in labels.read_labels(spark, path).collect()}
    assert again[3] == "keep" and again[900] == "keep" and len(again) == 201


def _scan(spark, path, number, files):
    rows = [(number, p, s, m, v) for p, (s, m, v) in files.items()]
    schema = "scan int, file_path string, file_size long, file_modified timestamp_ntz, hash_version int"
    df = spark.createDataFrame(rows, schema.replace("timestamp_ntz", "string")).withColumn("file_modified", F.col("file_modified").cast("timestamp_ntz"))
    df.repartition(3).write.mode("append").parquet(path)
    return df.schema


def test_changes_continue_from_the_checkpoint(spark, tmp_path):
    """Six scans in five runs against the batch comparison of the last two: files come, go, come back, change and stay."""
    root, r = str(tmp_path), random.Random(8)
    scans = [{f"/f{i}": (r.randrange(3), r.choice([None, "2024-01-01 00:00:00"]), r.choice([1, 2, 2])) for i in range(60) if r.random() < 0.7} for _ in range(6)]
    for n, files in enumerate(scans, 1):
        schema = _scan(spark, f"{root}/in", n, files)
        if n == 2:
            continue  # the next run takes in two scans
        detect_changes(spark, spark.readStream.schema(schema).parquet(f"{root}/in"), f"{root}/out", f"{root}/ck", 2)
        got = {x.file_path: x.change for x in spark.read.parquet(f"{root}/out").filter(F.col("scan") == n).collect()}
        old, new = scans[n - 2] if n > 1 else {}, files
        want = {p: "new" if p not in old else "vanished" if p not in new else "unchanged" if old[p][:2] == new[p][:2] and old[p][2] == 2 else "changed" for p in old | new}
        assert got == want
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")


def test_change_stream_without_files(spark, tmp_path):
    schema = _scan(spark, str(tmp_path / "in"), 1, {"/a": (1, None, 2)})
    (tmp_path / "none").mkdir()
    detect_changes(spark, spark.readStream.schema(schema).parquet(str(tmp_path / "none")), str(tmp_path / "out"), str(tmp_path / "ck"), 2)
    assert not (tmp_path / "out").exists()


def _rows(spark, n=60):
    return spark.createDataFrame([(i, [float(i % 2), float(i % 3)], i % 2) for i in range(n)], "file_id long, features array<double>, label int")


def test_model_store(spark, tmp_path):
    rows, store = _rows(spark), models.ModelStore(spark, str(tmp_path / "m"), most=2)
    features = rows.select("file_id", F.col("features").alias("embedding"))
    with pytest.raises(ValueError):
        store.score(features)
    fitted = [prefs.train(rows.withColumn("label", F.lit(1) - F.col("label")) if k == 1 else rows, rounds=0) for k in range(3)]
    for k, model in enumerate(fitted):
        assert store.save(model, 60 + k) == k + 1
    assert [(v.version, v.training_samples, v.is_current) for v in store.versions().orderBy("version").collect()] == [(2, 61, False), (3, 62, True)]
    want = {x.file_id: x.ai_raw_score for x in prefs.batch_score(fitted[1], features, 2).collect()}
    store.rollback(2)
    got = {x.file_id: (x.ai_raw_score, x.model_version) for x in models.ModelStore(spark, str(tmp_path / "m")).score(features).collect()}
    assert got == {i: (p, 2) for i, p in want.items()}
    with pytest.raises(ValueError):
        store.rollback(1)  # no longer kept


@pytest.mark.parametrize("gamma", [0.0, 2.0])
def test_gradient(gamma):
    """Against differences of the loss, with dropout."""
    draw = np.random.default_rng(3)
    net = network.Network.start(5, network.Settings(hidden=7, gamma=gamma))
    x, y, w = draw.normal(size=(20, 5)), draw.integers(0, 2, 20).astype(float), draw.uniform(0.5, 2, 20)
    kept = network.keeps(np.arange(20), 7, 0.3, 4)
    _, g = net.gradient(x, y, w, kept)
    for i in range(0, len(g), 3):
        step = np.zeros(len(g))
        step[i] = 1e-6
        up, down = (network.replace(net, weights=net.weights + s).gradient(x, y, w, kept)[0] for s in (step, -step))
        assert g[i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_dropout_keeps_its_share():
    kept = network.keeps(np.arange(2000), 50, 0.3, 1)
    assert abs((kept > 0).mean() - 0.7) < 0.01 and abs(kept.mean() - 1) < 0.02
    assert (network.keeps(np.arange(1000, 2000), 50, 0.3, 1) == kept[1000:]).all() and network.keeps(np.arange(3), 2, 0.0, 1) is None


def test_network_learns_and_keeps_the_best(spark):
    """A rule that no line can draw; results do not depend on how rows are spread; the weights kept are the best ones."""
    draw = random.Random(2)
    rows = [(i, [draw.choice([-1.0, 1.0]), draw.choice([-1.0, 1.0])]) for i in range(200)]
    df = spark.createDataFrame([(i, x, int(x[0] * x[1] > 0)) for i, x in rows], "file_id long, features array<double>, label int")
    settings = network.Settings(hidden=16, epochs=12, rate=0.05, dropout=0.1)
    net, losses = network.train_network(df, settings)
    assert min(losses) < 0.3 * losses[0]
    held = prefs.split(df).filter("is_validation").toPandas()
    weight = prefs.split(df).filter("not is_validation").groupBy("label").count().toPandas().set_index("label")["count"]
    w = np.array([weight.sum() / (2 * weight[k]) for k in held["label"]])
    loss = network.focal(net.logits(np.array(held["features"].tolist()))[0], held["label"].to_numpy(float), 2.0)[0] @ w / w.sum()
    assert loss == pytest.approx(min(losses))
    other, _ = network.train_network(df.repartition(7), settings)
    assert np.allclose(other.weights, net.weights, atol=1e-6)
    scores = network.score_network(net, df.select("file_id", F.col("features").alias("embedding")), 3).collect()
    assert sum((s.ai_prediction == "keep") == (rows[s.file_id][1][0] * rows[s.file_id][1][1] > 0) for s in scores) > 190 and len(scores) == 200


def test_network_is_no_worse_than_logistic_regression(spark):
    """Focal loss on the validation part of the given labels."""
    rows = training_rows(spark, "/root/testdata/sf0.01")
    net, losses = network.train_network(rows)
    assert len(losses) <= 51
    parts = prefs.split(rows)
    held = parts.filter("is_validation").select("file_id", F.col("features").alias("embedding"), "label")
    y = dict(held.select("file_id", "label").collect())

    def loss(scores):
        found = [(s.ai_raw_score, y[s.file_id]) for s in scores.collect()]
        p, t = np.array(found).T
        return network.focal(np.log(p / (1 - p)), t, 2.0)[0].mean()

    linear = prefs.train(parts.filter("not is_validation"))
    assert loss(network.score_network(net, held, 1)) <= loss(prefs.batch_score(linear, held, 1))


def test_scratch_tables_are_released(spark):
    """Tables made inside are gone, also after an error and in scopes inside; those made before stay."""
    kept = scratch.scratch_path(spark, "kept")
    with pytest.raises(ZeroDivisionError), scratch.released(spark):
        first = scratch.staged(spark.range(5), "first")
        with scratch.released(spark):
            inner = scratch.staged(spark.range(6), "inner")
        assert first.count() == 5 and not os.path.exists(inner.inputFiles()[0].removeprefix("file://"))
        first.write.parquet(kept)
        file = first.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(file)
        1 / 0
    assert not os.path.exists(file) and spark.read.parquet(kept).count() == 5
    assert scratch.staged(spark.range(3), "outside").count() == 3


def test_track_files_round_trip(spark, tmp_path):
    points = spark.sql("select * from values ('2024-01-01 00:00:00.123456', 1.25d, -7.5d), ('2024-06-01 12:00:00', 1e-7d, 179.999999d), ('2024-06-01 12:00:01', null, 2d) as t(ts, lat, lng)")
    points = points.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    catalog.write_track(points, str(tmp_path / "t"))
    read = catalog.read_tracks(spark, [str(tmp_path / "t")], 4)
    assert sorted(map(str, read.select("ts", "lat", "lng").collect())) == sorted(map(str, points.collect()))
