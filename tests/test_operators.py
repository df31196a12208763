import datetime
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import times
from shelfmark.operators import dedup, near_links, paging, prefs, similar, stats, tracks
from shelfmark.operators.components import connected_components
from shelfmark.plans import actions
from shelfmark.sources import catalog
from shelfmark.streaming.incremental import follow


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(60)], [(random.Random(3).randrange(80), i) for i in range(60)], [(5, 5), (9, 3), (3, 9)]])
def test_components(spark, edges):
    got = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == components([e for e in edges if e[0] != e[1]])
    assert len(got) == len({r.node for r in got})


def test_components_ignore_nulls(spark):
    got = connected_components(spark.createDataFrame([(1, None), (2, 3)], "src long, dst long")).collect()
    assert {r.node: r.component for r in got} == {2: 2, 3: 2}


@pytest.mark.parametrize("t", [4, 8, 12])
def test_hamming_join_equals_all_pairs(spark, t):
    r = random.Random(t)
    values = []
    for _ in range(40):
        base = r.getrandbits(64)
        for k in range(0, 14, 3):
            h = base
            for b in r.sample(range(64), k):
                h ^= 1 << b
            values.append(h - (1 << 64) if h >> 63 else h)
    hashes = spark.createDataFrame([(v,) for v in values], "h long")
    got = {(x.a, x.b, x.distance) for x in similar.hamming_pairs(hashes, t).collect()}
    want = {(a, b, d) for a, b in itertools.combinations(sorted(set(values)), 2) if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= t}
    assert got == want and want


def test_hamming_join_with_crowded_bands(spark):
    """Hashes that agree on most bits: the bands they crowd on get fewer flips, and no pair is lost."""
    r = random.Random(5)
    values = sorted({(0x0123_4567_89AB << 16 | r.getrandbits(16)) ^ (1 << r.randrange(64) if r.random() < 0.5 else 0) for _ in range(300)})
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(x.a, x.b) for x in similar.hamming_pairs(spark.createDataFrame([(v,) for v in values], "h long"), 4).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(sorted(values), 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    even, crowded = similar.bands_for(4, 10**6), similar.bands_for(4, 10**6, [2.0**-22, 1.0, 1.0], 3)
    assert sum(s + p + 1 for *_, s, p in crowded) == sum(s + p + 1 for *_, s, p in even) == 5
    assert len(crowded) == 1 and crowded[0][0] == 0  # only the first band tells hashes apart


@pytest.mark.parametrize("way", ["bands", "rounds"])
def test_hamming_ways_agree_and_keep_tasks_apart(spark, way, monkeypatch):
    """Both ways, the second in several rounds, give all pairs; a side that flips make longer is never broadcast."""
    r = random.Random(7)
    base = [r.getrandbits(63) for _ in range(20)]
    rows = sorted({(k % 2, b ^ sum(1 << i for i in r.sample(range(63), k))) for b in base for k in range(8)})
    values = spark.createDataFrame([(a, h, h % 1000) for a, h in rows], "task_id long, h long, rep long")
    monkeypatch.setattr(similar, "BLOCK", 30)
    if way == "bands":
        found = similar._banded(values, 9, similar.bands_for(9, len(rows)), ("rep",))
        assert "Broadcast" not in found._jdf.queryExecution().sparkPlan().toString()
    else:
        found = similar._all_pairs(values, 9, len(rows), ("rep",))
    got = sorted((x.task_id, x.a, x.b, x.a_rep, x.b_rep, x.distance) for x in found.collect())
    want = [(i, a, b, a % 1000, b % 1000, (a ^ b).bit_count()) for (i, a), (j, b) in itertools.combinations(rows, 2) if i == j and (a ^ b).bit_count() <= 9]
    assert got == sorted(want) and want


@pytest.mark.parametrize("t", [0, 1, 4, 8, 12, 20, 64])
@pytest.mark.parametrize("size", [0, 10**3, 10**7, 10**10])
def test_band_thresholds_add_up(t, size):
    bands = similar.bands_for(t, size)
    assert sum(s + p + 1 for *_, s, p in bands) == t + 1


def test_similar_groups_chain_and_keep_tasks_apart(spark):
    rows = [(1, 10, 0), (1, 11, 0), (1, 12, 15), (1, 13, 255), (1, 14, -1), (2, 20, 0)]
    got = similar.similar_groups(spark.createDataFrame(rows, "task_id long, file_id long, h long"), 4).collect()
    assert sorted((r.group_id, r.file_id) for r in got) == [(10, 10), (10, 11), (10, 12), (10, 13)]


def test_similar_groups_read_texts_once(spark):
    """Later steps read stored hashes; none hashes the words again."""
    texts = spark.createDataFrame([(1, 1, "a b c d"), (1, 2, "A b c d"), (1, 3, "e f g h i")], "task_id long, file_id long, text string")
    found = similar.similar_groups(similar.simhashes(texts), 4)
    assert "md5" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.group_id, r.file_id) for r in found.collect()) == [(1, 1), (1, 2)]


def _written(monkeypatch):
    """Rows of each scratch table that ``similar`` writes from now on."""
    sizes, write = {}, similar.staged

    def counted(df, name, *by, **how):
        out = write(df, name, *by, **how)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(similar, "staged", counted)
    return sizes


@pytest.mark.parametrize("spread", [8, 64])
def test_similar_groups_of_a_crowd_write_no_list_of_pairs(spark, monkeypatch, spread):
    """All pairs of a crowd are near; what is written grows with its hashes, in bands and where all are compared."""
    crowd = [sum(1 << b * spread // 8 for b in c) for c in itertools.combinations_with_replacement(range(8), 2)]
    rows = [(1, i, h ^ (k << 40)) for i, (h, k) in enumerate(itertools.product(sorted(set(crowd)), range(4)))]
    sizes = _written(monkeypatch)
    got = similar.similar_groups(spark.createDataFrame(rows, "task_id long, file_id long, h long"), 6).collect()
    assert {(r.group_id, r.file_id) for r in got} == {(0, i) for _, i, _ in rows}
    pairs = sum((a ^ b).bit_count() <= 6 for (*_, a), (*_, b) in itertools.combinations(rows, 2))
    assert max(sizes.values()) <= 7 * len(rows) < pairs


@pytest.mark.parametrize(("t", "run"), [(0, 8), (4, 8), (4, 10**6), (9, 8), (16, 8), (16, 50), (64, 8)])
def test_components_of_runs_equal_all_pairs(spark, monkeypatch, t, run):
    """Crowds in several blocks and in one run, in bands and all compared, of two tasks."""
    r = random.Random(t)
    base = [r.getrandbits(63) for _ in range(12)]
    bits = {(n % 2, b ^ sum(1 << i for i in r.sample(range(40, 63), k % 7))) for n, b in enumerate(base) for k in range(20)}
    rows = [(task, n, h) for n, (task, h) in enumerate(sorted(bits))] + [(1, 990, None), (None, 991, base[0]), (1, None, base[1] ^ 1)]
    monkeypatch.setattr(similar, "RUN", run)
    hashes = spark.createDataFrame(rows, "task_id long, file_id long, h long")
    found = {x.node: x.component for x in similar.near_components(similar.hash_classes(hashes), t).collect()}
    near = [(i, j) for (a, i, g), (b, j, h) in itertools.combinations(rows[:-3], 2) if a == b and (g ^ h).bit_count() <= t]
    assert found == components(near) and (near or t == 0)


@pytest.mark.parametrize("own", [True, False])
def test_links_of_a_run_are_few_and_enough(monkeypatch, own):
    """Tiles that do not fit evenly, hashes that begin in components; no link within what is linked already."""
    monkeypatch.setattr(near_links, "ROWS", 3), monkeypatch.setattr(near_links, "COLUMNS", 8), monkeypatch.setattr(near_links, "STEP", 10)
    r = np.random.default_rng(3)
    base = r.integers(0, 2**63, 6, dtype=np.uint64)
    h = base[r.integers(0, 6, 100)] ^ (np.uint64(1) << r.integers(0, 64, 100, dtype=np.uint64))
    h = np.concatenate([h, r.integers(0, 2**63, 11, dtype=np.uint64)])
    label = np.where(r.random(len(h)) < 0.5, np.arange(len(h)), 50)
    a, b = (h, h) if own else (h[:45], h[45:])
    got = [(int(x), int(y)) for xs, ys in near_links.links(a, b, label, 4, own) for x, y in zip(xs, ys, strict=True)]
    near = [(i, j) for i, j in itertools.combinations(range(len(h)), 2) if int(h[i] ^ h[j]).bit_count() <= 4 and (own or i < 45 <= j)]
    want = components([(int(label[i]), int(label[j])) for i, j in near if label[i] != label[j]])
    assert components(got) == want and len(got) == len(want) - len(set(want.values())) < len(near)


def test_runs_go_on_in_the_next_batch():
    import pyarrow as pa

    rows = [(1, 0, 5, n, n, 0, h, 10 * n + h) for n in range(4) for h in range(n + 1)] + [(1, 0, 5, 4, 5, s, h, 100 + 10 * s + h) for s in range(2) for h in (0, 255)]
    names = ["task_id", "k", "part", "lo", "hi", "side", "h", "label"]
    for size in (1, 2, 3, 100):
        batches = (pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows[i : i + size]]) for i in range(0, len(rows), size))
        got = [tuple(x.values()) for batch in near_links.links_of_runs(batches, 2) for x in batch.to_pylist()]
        assert components(got) == components([(10 * n, 10 * n + h) for n in range(4) for h in range(1, n + 1)] + [(100, 110), (355, 365)])
    assert not list(near_links.links_of_runs(iter([]), 2))


def _files(spark, rows):
    return spark.createDataFrame(rows, "task_id long, file_id long, file_path string, file_size long, has_exif boolean")


def test_funnel_and_keeper(spark):
    files = _files(spark, [(1, 1, "/long/path", 3, False), (1, 2, "/b", 3, True), (1, 3, "/c", 3, True), (1, 4, "/d", 3, True), (1, 5, "/e", None, True), (2, 6, "/f", 3, True), (1, 7, "/g", 9, True)])
    content = spark.createDataFrame([(1, "abc"), (2, "abc"), (3, "abc"), (4, "abd"), (5, "abc"), (6, "abc"), (7, "abc")], "file_id long, content string")
    rows = {r.file_id: (r.group_id, r.is_recommended) for r in dedup.exact_members(files, content).collect()}
    assert rows == {1: (1, False), 2: (1, True), 3: (1, False)}
    assert dedup.reclaimable(dedup.exact_members(files, content)).first()["bytes"] == 6


@pytest.mark.parametrize("maps", [1, 4])
def test_key_filter_loses_no_key(spark, maps):
    """Also when there are far more keys than its bitmaps have bits for."""
    rows, keys = spark.range(200_000).withColumnRenamed("id", "file_id"), spark.range(0, 200_000, 7).withColumnRenamed("id", "file_id")
    got = {r.file_id for r in dedup.key_filter(rows, keys.union(spark.sql("select cast(null as long)")), maps=maps).collect()}
    assert set(range(0, 200_000, 7)) <= got and (maps == 1 or len(got) < 80_000)
    assert dedup.key_filter(rows, keys.limit(0)).count() == 0
    few = {r.file_id for r in dedup.key_filter(rows, keys.limit(100)).collect()}
    assert len(few) < 1500


def test_funnel_moves_no_contents(spark):
    """Contents are scanned where they lie: no exchange carries them, and each of the two hashes scans them once."""
    files = spark.range(100).select(F.lit(1).alias("task_id"), F.col("id").alias("file_id"), F.lit(8).alias("file_size"))
    content = spark.range(100).select(F.col("id").alias("file_id"), F.format_string("%08d", F.col("id") % 40).alias("content"))
    for of in (dedup.quick_hash, dedup.full_hash):
        prints = dedup.fingerprints(content, files, of)
        plan = prints._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("format_string") == 1
        text = spark._jvm.PythonSQLUtils.explainString(prints._jdf.queryExecution(), "formatted")
        moved = re.findall(r"\) \w*Exchange[^\n]*\nInput \[\d+\]: ([^\n]*)", text)
        assert moved and not any("content" in x for x in moved) and prints.count() == 100
    stages = dedup.funnel(files, content)
    assert {n: df.count() for n, df in stages.items()} == {"size": 100, "quick": 100, "full": 100}
    assert all("content" not in df.columns for df in stages.values())


def test_uncovered_keeps_partly_covered_groups_whole(spark):
    similar_ = spark.createDataFrame([(1, 1, 1), (1, 1, 2), (1, 3, 3), (1, 3, 4)], "task_id long, group_id long, file_id long")
    exact = spark.createDataFrame([(1, 7, 1), (1, 8, 2), (1, 9, 3)], "task_id long, group_id long, file_id long")
    assert sorted(r.file_id for r in dedup.uncovered(similar_, exact).collect()) == [3, 4]


def _ts(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def test_track_match(spark):
    points = _ts(spark.createDataFrame([(1, "2024-01-01 10:00:00", 0.0, 0.0), (1, "2024-01-03 10:00:00", 10.0, 20.0)], "task_id long, ts string, lat double, lng double"), "ts")
    photos = [(1, 1, "2024-01-01 09:55:00"), (1, 2, "2024-01-01 09:54:59"), (1, 3, "2024-01-02 10:00:00"), (1, 4, "2024-01-03 10:00:00"), (1, 5, "2024-01-09 00:00:00"), (2, 6, "2024-01-01 10:00:00"), (1, 7, "2024-01-01 10:00:00")]
    photos = _ts(spark.createDataFrame(photos, "task_id long, file_id long, ts string"), "ts")
    got = {r.file_id: (r.matched_lat, r.matched_lng, r.time_offset_sec, r.match_quality) for r in tracks.match(photos, points).collect()}
    assert got == {
        1: (0.0, 0.0, -300, "good"), 2: (0.0, 0.0, -301, "warning"), 3: (5.0, 10.0, 86400, "warning"), 4: (10.0, 20.0, 0, "good"),
        5: (10.0, 20.0, 482400, "warning"), 6: (None, None, None, "no_match"), 7: (0.0, 0.0, 0, "good"),
    }


@pytest.mark.parametrize("most", [1, 7, 10**6])
def test_track_match_in_one_busy_hour(spark, most):
    """A task whose points lie in one hour is cut into ranges of seconds; the matches stay those of a plain search."""
    r = random.Random(2)
    day = datetime.datetime(2024, 1, 1, 10)
    at = sorted({day + datetime.timedelta(seconds=r.randrange(3600), microseconds=r.choice([0, 5])) for _ in range(120)})
    points = spark.createDataFrame([(1, t.isoformat(" "), float(i), 0.0) for i, t in enumerate(at)], "task_id long, ts string, lat double, lng double")
    asked = [day + datetime.timedelta(seconds=r.randrange(-100, 3700)) for _ in range(80)] + at[:5]
    photos = spark.createDataFrame([(1, i, t.isoformat(" ")) for i, t in enumerate(asked)], "task_id long, file_id long, ts string")
    points, photos = _ts(points, "ts"), _ts(photos, "ts")
    got = {x.file_id: x.time_offset_sec for x in tracks.match(photos, points, most).collect()}
    for i, t in enumerate(asked):
        before, after = [x for x in at if x < t], [x for x in at if x >= t]
        gaps = [(t - x).total_seconds() for x in before[-1:] + after[:1]]
        want = int(min(map(abs, gaps))) if len(gaps) == 2 else int(gaps[0])
        assert got[i] == want
    held = tracks.with_ranges(points, "ts", most).groupBy("bucket").count().agg(F.max("count"), F.count("*")).first()
    assert most > 100 or (held[0] <= most + 4 and held[1] > 100 / (most + 4))
    assert [x.idx for x in tracks.row_index(points, most=most).orderBy("ts").collect()] == list(range(len(at)))


def test_track_match_without_points(spark):
    points = _ts(spark.createDataFrame([], "task_id long, ts string, lat double, lng double"), "ts")
    photos = _ts(spark.createDataFrame([(1, 1, "2024-01-01 09:55:00")], "task_id long, file_id long, ts string"), "ts")
    assert tracks.match(photos, points).first()["match_quality"] == "no_match"


def test_downsample_adds_the_last_row(spark):
    rows = [(1, f"2024-01-0{1 + i // 5} 00:00:{i:02}", float(i)) for i in range(10)]
    points = _ts(spark.createDataFrame(rows, "task_id long, ts string, lat double"), "ts")
    assert [int(r.lat) for r in tracks.downsample(points, 4).orderBy("i").collect()] == [0, 2, 5, 7, 9]
    assert tracks.downsample(points, 10).count() == 10


def test_pages(spark):
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "id long, x string")
    assert [r.id for r in paging.page(df, "x", "id").collect()] == [2, 3, 1]
    assert [r.id for r in paging.page(df, "x", "id", descending=True, number=2, size=2).collect()] == [2]
    assert [r.id for r in paging.page(df, "nope", "id", default="x").collect()] == [2, 3, 1]
    assert "TakeOrderedAndProject" in paging.page(df, "x", "id")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages(spark, descending):
    """Every page equals the plain one, with nulls and many equal values; a deep page reads few ranges."""
    df = spark.createDataFrame([(i, None if i % 9 == 0 else i % 4) for i in range(500)], "id long, x int")
    ranked = paging.Ranked(df, "x", "id", descending, ranges=8)
    assert ranked.total == 500 and len(ranked.starts) == 8
    for number in (1, 3, 17, 36, 40):
        want = paging.page(df, "x", "id", descending, number, 14).collect()
        assert ranked.page(number, 14).collect() == want
    plan = ranked.page(30, 14)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range", plan) and "TakeOrdered" not in plan
    assert paging.Ranked(df.limit(0), "x", "id").page().collect() == []


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
def test_exact_quartiles(spark, accuracy):
    """A rough sketch, exact results: ties, one value, two values, and tasks of many sizes."""
    r = random.Random(6)
    rows = [(t, r.choice([5, r.randrange(10**15), 7])) for t, n in enumerate([1, 2, 3, 4, 50, 3000]) for _ in range(n)]
    df = spark.createDataFrame(rows, "task_id long, s long")
    want = {x.task_id: (x.a, x.b) for x in df.groupBy("task_id").agg(F.percentile("s", 0.25).alias("a"), F.percentile("s", 0.75).alias("b")).collect()}
    got = {x.task_id: (x.q1, x.q3) for x in times.exact_quartiles(df, accuracy).collect()}
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t], rel=1e-12) for t in want)


def test_predictions(spark):
    df = spark.createDataFrame([(0.5,), (0.51,), (0.0,)], "p double").select(prefs.prediction(F.col("p")).alias("l"), F.round(prefs.confidence(F.col("p")), 6).alias("c"))
    assert [tuple(r) for r in df.collect()] == [("delete", 0.0), ("keep", 0.02), ("delete", 1.0)]


def test_split_sizes_and_gate(spark):
    rows = spark.createDataFrame([(i, [float(i)], int(i < 3)) for i in range(20)], "file_id long, features array<double>, label int")
    got = prefs.split(rows).groupBy("label").agg(F.count_if("is_validation").alias("v")).collect()
    assert {r.label: r.v for r in got} == {1: 1, 0: 3}
    with pytest.raises(ValueError):
        prefs.ready(rows)


def test_split_ranks_no_class_in_one_window(spark):
    rows = spark.range(3000).select(F.col("id").alias("file_id"), (F.col("id") < 7).cast("int").alias("label"))
    split = prefs.split(rows)
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert all("_range" in x.split("],")[-2] for x in plan.splitlines() if "row_number()" in x) and "row_number()" in plan
    drawn = rows.withColumn("draw", F.xxhash64("file_id", F.lit(42))).collect()
    want = {r.file_id for k in (0, 1) for own in [sorted((r for r in drawn if r.label == k), key=lambda r: r.draw)] for r in own[: max(1, len(own) // 5)]}
    assert {r.file_id for r in split.filter("is_validation").collect()} == want


def test_train_and_score(spark):
    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 3)], i % 2) for i in range(60)], "file_id long, features array<double>, label int")
    model = prefs.train(rows)
    got = prefs.batch_score(model, rows.select("file_id", F.col("features").alias("embedding")), 3).collect()
    assert all((r.ai_prediction == "keep") == bool(r.file_id % 2) for r in got) and len(got) == 60
    assert prefs.batch_score(prefs.train(rows, "network", hidden=4), rows.select("file_id", F.col("features").alias("embedding")), 4).count() == 60


def test_logistic_scores_need_no_function_of_mllib(spark):
    """They are what the fitted model gives, from a plan that Spark can send out without a Scala function in it."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = spark.createDataFrame([(i, [float(i % 2), float(i % 3) / 3], int(i % 5 > 1)) for i in range(60)], "file_id long, features array<float>, label int")
    model = prefs.train(rows)
    features = rows.select("file_id", F.col("features").alias("embedding"))
    scores = prefs.batch_score(model, features, 1)
    assert "UDF" not in scores._jdf.queryExecution().toString()
    wide = features.withColumn("vector", array_to_vector(F.col("embedding").cast("array<double>")))
    want = {r.file_id: r.p for r in model.transform(wide).select("file_id", vector_to_array("probability")[1].alias("p")).collect()}
    assert {r.file_id: r.ai_raw_score for r in scores.collect()} == pytest.approx(want, abs=1e-12)


def test_metrics_of_an_empty_table(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert tuple(stats.metrics(df, "a", "b").first()) == (0.0, 0.0, 0.0, 0.0)


def test_upserts_keep_the_other_half(spark):
    old = spark.createDataFrame([(1, 1, "keep", "delete", 0.5, 0.2, 1)], "file_id long, task_id long, user_label string, ai_prediction string, ai_confidence double, ai_raw_score double, model_version int")
    new = spark.createDataFrame([(1, 1, "keep", 0.9, 0.95, 2), (2, 1, "delete", 0.1, 0.45, 2)], "file_id long, task_id long, ai_prediction string, ai_confidence double, ai_raw_score double, model_version int")
    got = {r.file_id: (r.user_label, r.ai_prediction) for r in prefs.upsert_predictions(old, new).collect()}
    assert got == {1: ("keep", "keep"), 2: (None, "delete")}


def test_plans(spark):
    files = spark.createDataFrame([(i, f"/p/{i}", 10) for i in range(4)], "file_id long, file_path string, file_size long")
    members = spark.createDataFrame([(1, "delete"), (1, "delete"), (2, "keep")], "file_id long, user_action string")
    plan = actions.delete_duplicates(members, files)
    assert [r.file_id for r in plan.collect()] == [1] and stats.freed(plan).first()["bytes"] == 10
    named = spark.sql("select * from values (1, 'a.jpg'), (2, 'a.jpg'), (3, 'b') as t(file_id, file_name)").withColumn("best_time", F.lit("2024-05-05 00:00:00").cast("timestamp_ntz"))
    assert {r.file_id: r.target for r in actions.organise(named).collect()} == {1: "2024/05/a.jpg", 2: "2024/05/a-1.jpg", 3: "2024/05/b"}


def test_organise_takes_free_names_only(spark, monkeypatch):
    """Against taking the first free number file by file, with numbered originals, names without extension and hidden ones."""
    monkeypatch.setattr(actions, "_RANGE_BITS", 2)
    r = random.Random(4)
    names = ["a.jpg", "a.jpg", "a-1.jpg", "a-3.jpg", "a-1-1.jpg", "b", "b-1", "b-02", "b-2.jpg", ".profile", ".profile-1", "-1.jpg", "c.tar.gz", "c-1.tar.gz", "c.tar-1.gz", "d..jpg", "d.-1.jpg"]
    names = names[:3] + [r.choice(names) for _ in range(200)]
    rows = spark.createDataFrame(list(enumerate(names)), "file_id long, file_name string").withColumn("best_time", F.lit("2024-05-05 00:00:00").cast("timestamp_ntz"))
    got = {x.file_id: x.target for x in actions.organise(rows.repartition(3)).collect()}
    own, used, want = {n: names.index(n) for n in names}, set(names), {}
    for i, n in enumerate(names):
        new = n
        if own[n] != i:
            dot = n.rfind(".")
            stem, ext = (n[:dot], n[dot:]) if dot > 0 and n[dot - 1] != "." and dot < len(n) - 1 else (n, "")
            new = next(f"{stem}-{k}{ext}" for k in itertools.count(1) if f"{stem}-{k}{ext}" not in used)
        used.add(new)
        want[i] = "2024/05/" + new
    assert got == want and len(set(got.values())) == len(names)


def test_sources(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (folder / "a.JPG").write_bytes(b"12345")
    got = catalog.scan_files(spark, str(tmp_path / "in"), 7).first()
    assert (got.relative_path, got.extension, got.file_size, got.task_id) == ("sub/a.JPG", ".jpg", 5, 7)
    assert catalog.file_contents(spark, str(tmp_path / "in")).first()["file_id"] == got.file_id
    (tmp_path / "t.gpx").write_text('<gpx><trk><trkseg><trkpt lat="1.5" lon="2.5"><time>2024-01-01T00:00:00Z</time></trkpt><trkpt lat="3" lon="4"/></trkseg></trk><rte><rtept lat="5" lon="6"><time>2024-01-01T00:00:01Z</time></rtept></rte></gpx>')
    pts = catalog.read_tracks(spark, [str(tmp_path / "t.gpx")], 1).orderBy("point_seq").collect()
    assert [(p.lat, p.lng, str(p.ts)) for p in pts] == [(1.5, 2.5, "2024-01-01 00:00:00"), (5.0, 6.0, "2024-01-01 00:00:01")]
    snap = str(tmp_path / "snap")
    catalog.write_snapshot(spark.sql("select 1 task_id, 1 x union all select 2, 2"), snap)
    catalog.write_snapshot(spark.sql("select 2 task_id, 3 x"), snap)
    assert sorted((r.task_id, r.x) for r in spark.read.parquet(snap).collect()) == [(1, 1), (2, 3)]
    assert catalog.table_of_task(spark, snap, 2).count() == 1


def test_changes(spark):
    old = spark.sql("select * from values ('a', 1L, 2), ('b', 1L, 2), ('c', 1L, 2), ('d', 1L, 1) as t(file_path, file_size, hash_version)").withColumn("file_modified", F.lit(None).cast("timestamp_ntz"))
    new = spark.sql("select * from values ('a', 1L), ('b', 2L), ('e', 1L), ('d', 1L) as t(file_path, file_size)").withColumn("file_modified", F.lit(None).cast("timestamp_ntz"))
    assert {r.file_path: r.change for r in catalog.changes(old, new, 2).collect()} == {"a": "unchanged", "b": "changed", "c": "vanished", "d": "changed", "e": "new"}


def test_follow_adds_each_file_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "file_id long, x string"
    for n, rows in enumerate(([(1, "a"), (1, "a")], [(1, "a"), (2, "b")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        follow(spark, spark.readStream.schema(schema).parquet(src), lambda d: d.withColumn("y", F.upper("x")), out, str(tmp_path / "ck")).awaitTermination()
        assert spark.read.parquet(out).count() == n + 1


def test_audit_round_trip(spark):
    plan = spark.sql("select 1 task_id, '/x' file_path, 5 file_size")
    log = actions.audit(plan, "delete", F.lit("2024-01-01").cast("timestamp_ntz"), "file_size").withColumn("log_id", F.lit(1))
    got = actions.audit_page(log, task_id=1, operation="delete").select(F.get_json_object("detail", "$.file_size")).first()[0]
    assert got == "5"


def test_versions(spark):
    reg = spark.sql("select 1 version, true is_current, 10 n union all select 2, false, 11")
    new = prefs.register_version(reg, spark.sql("select 12 n"))
    assert {r.version: r.is_current for r in new.collect()} == {1: False, 2: False, 3: True}
    assert {r.version: r.is_current for r in prefs.rollback(new, 1).collect()} == {1: True, 2: False, 3: False}
    assert {r.version: r.is_current for r in prefs.rollback(new, 99).collect()} == {1: False, 2: False, 3: True}
    assert [r.version for r in prefs.retain(new, 2).collect()] == [3, 2]
