"""Times, tracks and positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import formats, times
from shelfmark.operators import stats, tracks
from shelfmark.plans import actions
from shelfmark.queries import recipes as r

_OFFSET = 5400


def _resolved(s, d):
    return times.resolve(r.event_files(s, d), r.now())


def best_time(s, d):
    return _resolved(s, d).select("file_id", "time_source", times.display(F.col("best_time")).alias("best_time"), F.unix_micros(F.col("best_time").cast("timestamp")).alias("us"))


def time_anomalies(s, d):
    return times.flagged(_resolved(s, d), r.now()).select("file_id", "time_anomaly")


def exif_stats(s, d):
    return stats.exif_stats(_resolved(s, d).withColumn("time_anomaly", times.anomalies(r.now())))


def time_offset_preview(s, d):
    return times.offset_times(_resolved(s, d), _OFFSET, r.now()).select("file_id", times.display(F.col("best_time")).alias("best_time"), "time_anomaly")


def manual_override(s, d):
    files = _resolved(s, d)
    wanted = files.filter("file_id % 10 = 3").select("file_id", F.lit("2023-05-06 07:08:09").cast("timestamp_ntz").alias("new_time_utc"))
    out = times.override_times(files, wanted, r.now())
    return out.select("file_id", "has_exif", "time_source", times.display(F.col("best_time")).alias("best_time"), "time_anomaly")


def time_write_plan(s, d):
    files = _resolved(s, d)
    plan = actions.write_times(files, times.offset_times(files, _OFFSET, r.now()))
    return plan.select("file_id", times.display(F.col("old_time")).alias("old_time"), times.display(F.col("new_time")).alias("new_time"), "target")


def time_outliers(s, d):
    return times.time_outliers(_resolved(s, d)).groupBy("task_id").agg(F.count("*").alias("files"), F.count_if("is_outlier").alias("outliers"))


def track_merge(s, d):
    points = r.track_points(s, d).withColumn("ts", F.date_trunc("minute", "ts").cast("timestamp_ntz"))
    return tracks.merge_tracks(points).select("point_seq", "source_rank", "lat", "lng")


def _matches(s, d):
    return tracks.match(r.track_photos(s, d), tracks.merge_tracks(r.track_points(s, d)))


def gpx_match(s, d):
    out = _matches(s, d)
    return out.select("task_id", "file_id", F.round("matched_lat", 6).alias("matched_lat"), F.round("matched_lng", 6).alias("matched_lng"), "time_offset_sec", "match_quality", formats.offset_text(F.col("time_offset_sec")).alias("offset_text"))


def gpx_stats(s, d):
    return tracks.match_stats(_matches(s, d).withColumn("user_confirmed", F.col("file_id") % 4 == 0))


def gpx_write_plan(s, d):
    files = r.event_files(s, d).select("file_id", "file_name", (F.col("file_id") % 5 == 0).alias("original_has_gps"))
    return actions.write_positions(_matches(s, d).filter("task_id = 1"), files).select("file_id", "decision", "lat_dms.d", F.col("lat_dms.m").alias("m"), F.col("lat_dms.ref").alias("ref"))


def gpx_apply(s, d):
    files = r.event_files(s, d).selectExpr("file_id", "cast(null as double) gps_lat", "cast(null as double) gps_lng", "false has_gps")
    out = actions.apply_positions(files, _matches(s, d).filter("task_id = 1"))
    return out.select("file_id", "has_gps", formats.coordinate_text(F.round("gps_lat", 4), F.round("gps_lng", 4)).alias("position"))


def gpx_clear(s, d):
    """What the catalog shows for files with a position that is then cleared."""
    files = r.event_files(s, d).selectExpr("file_id", "1.5D gps_lat", "2.5D gps_lng", "true has_gps")
    out = actions.clear_positions(files)
    return out.select("file_id", "has_gps", formats.coordinate_text(F.col("gps_lat"), F.col("gps_lng")).alias("position"))


def gpx_dms(s, d):
    """Both coordinates of all points as degrees, minutes and seconds, some on the other hemispheres."""
    sign = F.when(F.col("point_seq") % 2 == 0, 1.0).otherwise(-1.0)
    points = r.track_points(s, d).select("point_seq", (sign * F.col("lat")).alias("lat"), (sign * F.col("lng")).alias("lng"))
    both = points.select("point_seq", formats.to_dms(F.col("lat"), "N", "S").alias("lat"), formats.to_dms(F.col("lng"), "E", "W").alias("lng"))
    return both.select("point_seq", *(F.col(f"{c}.{p}").alias(f"{c}_{p}") for c in ("lat", "lng") for p in ("d", "m", "s10000", "ref")))


def track_downsample(s, d):
    points = tracks.merge_tracks(r.track_points(s, d))
    return tracks.downsample(points, 500).select("i", "idx", "point_seq")


def track_bounds(s, d):
    return tracks.bounds(r.track_points(s, d))


def track_projection(s, d):
    out = tracks.project(tracks.merge_tracks(r.track_points(s, d)))
    return out.select("point_seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


_T = f"({r.EVENT_TIMES})"
_SHOW = "strftime(%s + interval 8 hours, '%%Y-%%m-%%d %%H:%%M:%%S')"
_MERGED = f"select * from ({r.TRACK_POINTS}) qualify row_number() over (partition by ts order by source_rank, point_seq) = 1"
_MATCH = f"""
    with p as ({_MERGED}), f as ({r.TRACK_PHOTOS}),
    b as (select f.task_id, f.file_id, f.ts, p.ts as bt, p.lat as blat, p.lng as blng from f asof left join p on f.task_id = p.task_id and f.ts > p.ts),
    a as (select f.task_id, f.file_id, f.ts, p.ts as at_, p.lat as alat, p.lng as alng from f asof left join p on f.task_id = p.task_id and f.ts <= p.ts),
    j as (select b.*, at_, alat, alng, date_diff('microsecond', bt, at_) / 1e6 as span, date_diff('microsecond', bt, b.ts) / 1e6 as done,
                 date_diff('microsecond', at_, b.ts) / 1e6 as past from b join a on b.task_id = a.task_id and b.file_id = a.file_id and b.ts = a.ts),
    m as (select *, case when span = 0 then 0 else greatest(0, least(1, done / span)) end as q from j),
    o as (select task_id, file_id, ts, case when bt is null then alat when at_ is null then blat else blat + q * (alat - blat) end as matched_lat,
                 case when bt is null then alng when at_ is null then blng else blng + q * (alng - blng) end as matched_lng,
                 cast(trunc(case when bt is null then past when at_ is null then done else least(abs(done), abs(past)) end) as bigint) as time_offset_sec,
                 bt is null and at_ is null as lost from m)
    select *, case when lost then 'no_match' when abs(time_offset_sec) <= 300 then 'good' else 'warning' end as match_quality from o"""

QUERIES = {f.__name__: f for f in (
    best_time, time_anomalies, exif_stats, time_offset_preview, manual_override, time_write_plan, time_outliers,
    track_merge, gpx_match, gpx_stats, gpx_write_plan, gpx_apply, gpx_clear, gpx_dms, track_downsample, track_bounds, track_projection,
)}

ORACLE_SQL = {
    "best_time": f"select file_id, time_source, {_SHOW % 'best_time'} as best_time, epoch_us(best_time) as us from {_T}",
    "time_anomalies": f"select * from (select file_id, {r.anomaly_sql()} as time_anomaly from {_T}) where time_anomaly is not null",
    "exif_stats": f"""select task_id, count(*) as total, count(*) filter (where has_exif) as with_exif, count(*) filter (where not has_exif) as no_exif,
        count(time_anomaly) as anomalies from (select *, {r.anomaly_sql()} as time_anomaly from {_T}) group by 1""",
    "time_offset_preview": f"""select file_id, {_SHOW % 'b'} as best_time, {r.anomaly_sql('b', 'e')} as time_anomaly
        from (select *, best_time + interval {_OFFSET} seconds as b, exif_time + interval {_OFFSET} seconds as e from {_T})""",
    "manual_override": f"""select file_id, h as has_exif, s as time_source, {_SHOW % 'b'} as best_time, {r.anomaly_sql('b', 'e', 'h')} as time_anomaly
        from (select file_id, modified, file_id % 10 = 3 or has_exif as h, case when file_id % 10 = 3 then 'manual' else time_source end as s,
              case when file_id % 10 = 3 then timestamp '2023-05-06 07:08:09' else best_time end as b,
              case when file_id % 10 = 3 then timestamp '2023-05-06 07:08:09' else exif_time end as e from {_T})""",
    "time_write_plan": f"""select file_id, {_SHOW % 'best_time'} as old_time, {_SHOW % f'(best_time + interval {_OFFSET} seconds)'} as new_time,
        case when file_name like '%.jpg' then 'jpeg' else 'db_only' end as target from {_T}""",
    "time_outliers": f"""with t as (select task_id, epoch_us(best_time)::double as s from {_T}),
        q as (select task_id, quantile_cont(s, 0.25) as q1, quantile_cont(s, 0.75) as q3 from t group by 1)
        select task_id, count(*) as files, count(*) filter (where s < q1 - 1.5 * (q3 - q1) or s > q3 + 1.5 * (q3 - q1)) as outliers from t join q using (task_id) group by 1""",
    "track_merge": f"""select point_seq, source_rank, lat, lng from (select * replace (date_trunc('minute', ts) as ts) from ({r.TRACK_POINTS}))
        qualify row_number() over (partition by ts order by source_rank, point_seq) = 1""",
    "gpx_match": f"""select task_id, file_id, round(matched_lat, 6) as matched_lat, round(matched_lng, 6) as matched_lng, time_offset_sec, match_quality,
        case when time_offset_sec is null then '-' else case when time_offset_sec >= 0 then '+' else '-' end || case when x >= 3600 then (x // 3600) || 'h' || (x % 3600 // 60) || 'm'
        when x >= 60 then (x // 60) || 'm' || (x % 60) || 's' else x || 's' end end as offset_text from (select *, abs(time_offset_sec) as x from ({_MATCH}))""",
    "gpx_stats": f"""select task_id, count(*) as total, count(*) filter (where match_quality = 'good') as good, count(*) filter (where match_quality = 'warning') as warning,
        count(*) filter (where match_quality = 'no_match') as no_match, count(*) filter (where file_id % 4 = 0) as confirmed from ({_MATCH}) group by 1""",
    "gpx_write_plan": f"""select file_id, case when file_id % 5 = 0 then 'skip' when file_name like '%.jpg' then 'write_exif' else 'db_only' end as decision,
        cast(floor(abs(matched_lat)) as bigint) as d, cast(floor((abs(matched_lat) - floor(abs(matched_lat))) * 60) as bigint) as m,
        case when matched_lat >= 0 then 'N' else 'S' end as ref
        from ({_MATCH}) join (select file_id, file_name from ({r.EVENT_FILES})) using (file_id) where task_id = 1 and match_quality != 'no_match'""",
    "gpx_clear": f"select file_id, false as has_gps, '-' as position from ({r.EVENT_FILES})",
    "gpx_dms": "select point_seq, " + ", ".join(
        f"""cast(floor(abs({c})) as bigint) as {c}_d, cast(floor((abs({c}) - floor(abs({c}))) * 60) as bigint) as {c}_m,
        cast(round_even(((abs({c}) - floor(abs({c}))) * 60 - floor((abs({c}) - floor(abs({c}))) * 60)) * 60 * 10000, 0) as bigint) as {c}_s10000,
        case when {c} >= 0 then '{a}' else '{b}' end as {c}_ref""" for c, a, b in (("lat", "N", "S"), ("lng", "E", "W")))
        + f" from (select point_seq, x * lat as lat, x * lng as lng from (select *, case when point_seq % 2 = 0 then 1.0::double else -1.0::double end as x from ({r.TRACK_POINTS})))",
    "gpx_apply": f"""select f.file_id, m.file_id is not null as has_gps, case when matched_lat is null then '-' else format('{{:.6f}}, {{:.6f}}', round(matched_lat, 4), round(matched_lng, 4)) end as position
        from ({r.EVENT_FILES}) f left join (select * from ({_MATCH}) where task_id = 1 and match_quality != 'no_match') m on f.file_id = m.file_id""",
    "track_downsample": f"""with p as (select *, row_number() over (order by ts) - 1 as idx, count(*) over () as n from ({_MERGED}))
        select i, p.idx, point_seq from (select unnest(range(case when n <= 500 then n else 501 end)) as i, n from (select max(n) as n from p)) w
        join p on p.idx = case when w.n <= 500 then i when i = 500 then w.n - 1 else i * w.n // 500 end""",
    "track_bounds": f"select task_id, min(lat) as min_lat, max(lat) as max_lat, min(lng) as min_lng, max(lng) as max_lng, count(*) as points from ({r.TRACK_POINTS}) group by 1",
    "track_projection": f"""with p as ({_MERGED}), b as (select min(lat) as lat0, max(lat) as lat1, min(lng) as lng0, max(lng) as lng1 from p),
        s as (select *, case when lng1 = lng0 then 0.001 else lng1 - lng0 end as c, case when lat1 = lat0 then 0.001 else lat1 - lat0 end as r from b),
        k as (select *, least(736.0 / c, 536.0 / r) as k from s)
        select point_seq, round(32 + (736.0 - c * k) / 2 + (lng - lng0) * k, 4) as x, round(32 + (536.0 - r * k) / 2 + (lat1 - lat) * k, 4) as y from p, k""",
}
