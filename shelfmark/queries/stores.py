"""Sources and sinks end to end: given tables are written to scratch in the forms the library reads, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.operators import network, paging, prefs, tracks
from shelfmark.plans import actions
from shelfmark.queries import recipes as r
from shelfmark.queries.learning import SELECTED, training_rows
from shelfmark.scratch import scratch_path
from shelfmark.sources import catalog, labels, models
from shelfmark.streaming.changes import detect_changes

#: Labelled rows that training needs.
GATE = 200


def scan_folder(s, d):
    """A folder of text files, scanned into a catalog: files by class and bytes by the sub-folder they lie in."""
    path = scratch_path(s, "library")
    lines = r.table(s, d, "documents").select("source", F.concat_ws(" ", F.col("doc_id").cast("string"), F.sha2("text", 256)).alias("value"))
    lines.write.partitionBy("source").text(path)
    files = catalog.scan_files(s, path, 1).filter("extension = '.txt'")
    folder = F.regexp_extract("relative_path", "^source=([^/]*)/", 1)
    return files.groupBy(folder.alias("folder"), "file_type", "mime_type").agg(F.sum("file_size").alias("bytes"))


def track_files(s, d):
    """Points of two sources written as track files, read back and merged to one point a second."""
    root, points = scratch_path(s, "tracks"), r.track_points(s, d)
    for rank in (0, 1):
        catalog.write_track(points.filter(F.col("source_rank") == rank), f"{root}/{rank}")
    read = catalog.read_tracks(s, [f"{root}/0", f"{root}/1"], 1).withColumn("ts", F.date_trunc("second", "ts").cast("timestamp_ntz"))
    return tracks.merge_tracks(read).groupBy("source_rank").agg(F.count("*").alias("points"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def track_points_read(s, d):
    """All points of the track files as they are read."""
    path = scratch_path(s, "tracks")
    catalog.write_track(r.track_points(s, d), path)
    return catalog.read_tracks(s, [path], 1).select("task_id", "ts", "lat", "lng")


def snapshot_replaced(s, d):
    """The catalog of all tasks, after a snapshot of task 1 that holds its images alone."""
    path, files = scratch_path(s, "catalog"), r.page_files(s, d)
    catalog.write_snapshot(files, path)
    catalog.write_snapshot(files.filter("task_id = 1 and file_type = 'image'"), path)
    return s.read.parquet(path).select("task_id", "file_id", "file_name", "file_size")


def task_snapshot(s, d):
    """One task of that catalog; the folders of the others are not read."""
    path = scratch_path(s, "catalog")
    catalog.write_snapshot(r.page_files(s, d), path)
    return catalog.table_of_task(s, path, 2).select("file_id", "file_path", "extension")


def audit_appended(s, d):
    """A log that two plans were appended to."""
    path, files = scratch_path(s, "log"), r.page_files(s, d)
    for ext in ("zip", "jpg"):
        catalog.append_log(actions.audit(actions.delete_by_extension(files, ext), f"delete_{ext}", r.now(), "file_id", "file_size"), path)
    log = s.read.parquet(path)
    return log.select("task_id", "operation_type", "file_path", F.get_json_object("detail", "$.file_size").cast("long").alias("file_size"), "created_at")


def label_merge(s, d):
    """A stored label table after the labels of two kinds of events were merged into it, the first of them twice."""
    path = scratch_path(s, "labels")
    old = r.preference_rows(s, d).withColumns({"labeled_at": F.lit("2023-12-31").cast("timestamp_ntz"), "label_source": F.lit("manual")})
    labels.write_labels(old, path)
    events = r.table(s, d, "events").selectExpr("event_type", "user_id as file_id", "1L as task_id", "if(event_type = 'view', 'keep', 'delete') as user_label", "ts as labeled_at")
    for kind in ("view", "click", "view"):
        labels.merge_labels(s, path, events.filter(F.col("event_type") == kind).drop("event_type"), prefs.upsert_labels)
    return labels.read_labels(s, path).select("file_id", "user_label", "ai_prediction", "label_source")


def change_stream(s, d):
    """Two scans of the orders, taken in by two runs of a stream that continues from its checkpoint."""
    root = scratch_path(s, "scans")
    o = r.table(s, d, "orders")
    columns = ["'/o/' || o_orderkey as file_path", "cast(o_totalprice as bigint) + %s as file_size", "o_orderdate as file_modified", "cast(%s as int) as hash_version", "%d as scan"]
    scans = [(o.filter("o_orderkey % 11 != 0"), "0", "if(o_orderkey % 13 = 0, 1, 2)"), (o.filter("o_orderkey % 7 != 0"), "if(o_orderkey % 5 = 0, 1, 0)", "2")]
    for n, (rows, more, version) in enumerate(scans, 1):
        rows = rows.selectExpr(columns[0], columns[1] % more, columns[2], columns[3] % version, columns[4] % n)
        rows.write.mode("append").parquet(f"{root}/listings")
        detect_changes(s, s.readStream.schema(rows.schema).parquet(f"{root}/listings"), f"{root}/changes", f"{root}/checkpoint", 2)
    return s.read.parquet(f"{root}/changes").filter("scan = 2").select("file_path", "change")


def file_page_deep(s, d):
    """The page in the middle of all documents by size: only the ranges it lies in are sorted."""
    ranked = paging.Ranked(r.document_files(s, d), "file_size", "file_id", descending=True)
    return ranked.page(ranked.total // 200 + 1, 100).select("file_id", "file_size", "file_path")


def _ready(s, d):
    """Training rows, if there are enough of them."""
    rows = training_rows(s, d)
    try:
        prefs.ready(rows, GATE)
    except ValueError:
        return None
    return rows


def stored_model_scores(s, d):
    """Scores by the version that was rolled back to, and whether they are those it gave when it was stored."""
    rows, features = _ready(s, d), r.table(s, d, "embeddings").selectExpr("vec_id as file_id", "embedding")
    if rows is None:
        return s.createDataFrame([], "file_id long, model_version int, same boolean")
    training, store = prefs.split(rows).filter("not is_validation"), models.ModelStore(s, scratch_path(s, "models"))
    first = prefs.train(training)
    store.save(first, training.count())
    store.save(prefs.train(training, rounds=0), training.count())
    store.rollback(1)
    then = prefs.batch_score(first, features, 1).select("file_id", F.col("ai_raw_score").alias("then"))
    return store.score(features).join(then, "file_id").select("file_id", "model_version", (F.abs(F.col("ai_raw_score") - F.col("then")) < 1e-12).alias("same"))


def network_scores(s, d):
    """Scores of all vectors by the trained network, by whether they and their parts agree."""
    rows = _ready(s, d)
    if rows is None:
        return s.createDataFrame([], "file_id long, model_version int, sound boolean")
    net, _ = network.train_network(rows)
    out = network.score_network(net, r.table(s, d, "embeddings").selectExpr("vec_id as file_id", "embedding"), 1)
    p = F.col("ai_raw_score")
    sound = p.between(0, 1) & (F.abs(F.col("ai_confidence") - F.abs(p - 0.5) * 2) < 1e-12) & (F.col("ai_prediction") == F.when(p > 0.5, "keep").otherwise("delete"))
    return out.select("file_id", "model_version", sound.alias("sound"))


def positions_applied_cleared(s, d):
    """Catalog positions after the matches were applied and those of one task cleared again."""
    files = r.track_photos(s, d).selectExpr("task_id", "file_id", "ts", "false as has_gps", "cast(null as double) as gps_lat", "cast(null as double) as gps_lng")
    found = tracks.match(files.select("task_id", "file_id", "ts"), r.track_points(s, d))
    applied = actions.apply_positions(files, found)
    kept, cleared = applied.filter("file_id % 2 = 0"), actions.clear_positions(applied.filter("file_id % 2 = 1"))
    return kept.unionByName(cleared).groupBy("task_id", "has_gps").agg(F.count("*").alias("files"), F.count("gps_lat").alias("positions"))


_ENOUGH = f"(select count(*) >= {GATE} and count(distinct label) = 2 from {SELECTED})"

QUERIES = {f.__name__: f for f in (
    scan_folder, track_files, track_points_read, snapshot_replaced, task_snapshot, audit_appended, label_merge, change_stream, file_page_deep,
    stored_model_scores, network_scores, positions_applied_cleared,
)}

ORACLE_SQL = {
    "scan_folder": """select coalesce(source, '__HIVE_DEFAULT_PARTITION__') as folder, 'other' as file_type, 'application/octet-stream' as mime_type,
        cast(sum(strlen(concat_ws(' ', doc_id, sha256(text))) + 1) as bigint) as bytes from documents group by 1""",
    "track_files": f"""with p as (select date_trunc('second', ts) as ts, min(source_rank) as source_rank from ({r.TRACK_POINTS}) group by 1)
        select source_rank, count(*) as points, min(ts) as first, max(ts) as last from p group by 1""",
    "track_points_read": f"select task_id, ts, lat, lng from ({r.TRACK_POINTS})",
    "snapshot_replaced": f"select task_id, file_id, file_name, file_size from ({r.PAGE_FILES}) where task_id != 1 or file_type = 'image'",
    "task_snapshot": f"select file_id, file_path, extension from ({r.PAGE_FILES}) where task_id = 2",
    "audit_appended": f"""select task_id, 'delete_' || substr(extension, 2) as operation_type, file_path, file_size, timestamp '{r.NOW}' as created_at
        from ({r.PAGE_FILES}) where extension in ('.zip', '.jpg')""",
    "label_merge": f"""with n as (select user_id as file_id, max(ts) filter (where event_type = 'view') as v, max(ts) filter (where event_type = 'click') as c
            from events where event_type in ('view', 'click') group by 1)
        select coalesce(p.file_id, n.file_id) as file_id, case when n.file_id is null then user_label when c is null or v >= c then 'keep' else 'delete' end as user_label,
            ai_prediction, 'manual' as label_source from ({r.PREFERENCE_ROWS}) p full join n on p.file_id = n.file_id""",
    "change_stream": """
        with o as (select '/o/' || o_orderkey as file_path, trunc(o_totalprice)::bigint as sz, case when o_orderkey % 13 = 0 then 1 else 2 end as v from orders where o_orderkey % 11 != 0),
        n as (select '/o/' || o_orderkey as file_path, trunc(o_totalprice)::bigint + case when o_orderkey % 5 = 0 then 1 else 0 end as sz from orders where o_orderkey % 7 != 0)
        select coalesce(o.file_path, n.file_path) as file_path, case when o.sz is null then 'new' when n.sz is null then 'vanished'
            when o.sz = n.sz and v = 2 then 'unchanged' else 'changed' end as change from o full join n on o.file_path = n.file_path""",
    "file_page_deep": f"""select file_id, file_size, file_path from (select *, row_number() over (order by file_size desc nulls last, file_id) - 1 as pos from ({r.DOCUMENT_FILES}))
        where pos >= 100 * ((select count(*) from documents) // 200) and pos < 100 * ((select count(*) from documents) // 200 + 1)""",
    "stored_model_scores": f"select vec_id as file_id, 1 as model_version, true as same from embeddings where {_ENOUGH}",
    "network_scores": f"select vec_id as file_id, 1 as model_version, true as sound from embeddings where {_ENOUGH}",
    "positions_applied_cleared": f"""with f as (select task_id, task_id = 1 and file_id % 2 = 0 as has_gps from ({r.TRACK_PHOTOS}))
        select task_id, has_gps, count(*) as files, count(*) filter (where has_gps) as positions from f group by 1, 2""",
}
