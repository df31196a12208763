"""The catalog tables that the registered queries derive from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import times
from shelfmark.functions.paths import classify

NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(
        "1L as task_id", "doc_id as file_id", "n_chars as file_size", "'/lib/' || source || '/' || doc_id as file_path", "doc_id % 2 = 0 as has_exif"
    )


def document_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr("doc_id as file_id", "text as content")


DOCUMENT_FILES = """select 1 as task_id, doc_id as file_id, n_chars as file_size, '/lib/' || source || '/' || doc_id as file_path,
    doc_id % 2 = 0 as has_exif, text as content from documents"""


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = "element_at(array('.jpg', '.JPG', '.mp4', '.cr2', '.zip', null), cast(page_id % 6 + 1 as int))"
    rows = table(spark, sf_dir, "pages").selectExpr(
        "page_id % 3 as task_id", "page_id as file_id", f"'f' || page_id || coalesce({ext}, '') as file_name", "cast(length(html) as bigint) as file_size", "url as file_path"
    )
    return classify(rows)


_PAGE_EXT = "lower((['.jpg', '.JPG', '.mp4', '.cr2', '.zip', null])[page_id % 6 + 1])"
PAGE_FILES = f"""select page_id % 3 as task_id, page_id as file_id,
    'f' || page_id || coalesce((['.jpg', '.JPG', '.mp4', '.cr2', '.zip', null])[page_id % 6 + 1], '') as file_name,
    cast(length(html) as bigint) as file_size, url as file_path, {_PAGE_EXT} as extension,
    case when {_PAGE_EXT} = '.jpg' then 'image' when {_PAGE_EXT} = '.mp4' then 'video' when {_PAGE_EXT} = '.cr2' then 'raw' else 'other' end as file_type,
    case when {_PAGE_EXT} = '.jpg' then 'image/jpg' when {_PAGE_EXT} = '.mp4' then 'video/mp4' when {_PAGE_EXT} = '.cr2' then 'image/cr2'
         else 'application/octet-stream' end as mime_type from pages"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directories of all page paths; one page in three counts as a file."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", F.filter(F.split(path, "/"), lambda p: p != "").alias("p"))
    files = rows.filter("page_id % 3 = 0").select(F.concat(F.array_join("p", "/"), F.lit("/page")).alias("path"), F.lit(False).alias("is_dir"))
    prefixes = F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))
    dirs = rows.select(F.explode(prefixes).alias("path")).distinct().withColumn("is_dir", F.lit(True))
    return files.unionByName(dirs)


def event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with names, EXIF strings and modification times made from the events."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", "user_id", "ts", "ts + interval 8 hours as local")
    stamp = lambda f: F.date_format("local", f)
    k = F.col("event_id") % 6
    name = (
        F.when(k == 0, F.concat(F.lit("IMG_"), stamp("yyyyMMddHHmmss"), F.lit(".jpg")))
        .when(k == 1, F.concat(stamp("yyyy-MM-dd"), F.lit("T"), stamp("HH-mm-ss"), F.lit(".jpg")))
        .when(k == 2, F.concat(F.lit("IMG_"), stamp("yyyyMMdd"), F.lit("_"), stamp("HHmmss"), F.lit(".jpg")))
        .when(k == 3, F.concat(F.lit("DSC_"), F.col("event_id").cast("string"), F.lit(".jpg")))
        .when(k == 4, F.concat(F.lit("Screenshot_"), stamp("yyyy-MM-dd-HH-mm-ss"), F.lit(".png")))
        .otherwise(F.concat(F.lit("IMG_1999"), stamp("MMddHHmmss"), F.lit(".jpg")))
    )
    q = F.col("event_id") % 4
    tag = (
        F.when(F.col("event_id") % 97 == 0, "1998:01:01 00:00:00")
        .when(q == 0, stamp("yyyy:MM:dd HH:mm:ss"))
        .when(q == 1, "bad")
        .when(q == 3, F.date_format(F.expr("local + interval 3 days"), "yyyy:MM:dd HH:mm:ss"))
    )
    out = e.select(
        (F.col("user_id") % 5).alias("task_id"), F.col("event_id").alias("file_id"), name.alias("file_name"), tag.alias("tag"),
        F.col("local").alias("file_modified"), F.lit(None).cast("timestamp_ntz").alias("file_created"),
    )
    return out.withColumns({"has_exif": F.col("tag").isNotNull(), "exif_time": times.exif_time(F.col("tag"))})


EVENT_FILES = """
    select user_id % 5 as task_id, event_id as file_id, ts + interval 8 hours as file_modified,
      case event_id % 6
        when 0 then 'IMG_' || strftime(ts + interval 8 hours, '%Y%m%d%H%M%S') || '.jpg'
        when 1 then strftime(ts + interval 8 hours, '%Y-%m-%dT%H-%M-%S') || '.jpg'
        when 2 then 'IMG_' || strftime(ts + interval 8 hours, '%Y%m%d_%H%M%S') || '.jpg'
        when 3 then 'DSC_' || event_id || '.jpg'
        when 4 then 'Screenshot_' || strftime(ts + interval 8 hours, '%Y-%m-%d-%H-%M-%S') || '.png'
        else 'IMG_1999' || strftime(ts + interval 8 hours, '%m%d%H%M%S') || '.jpg' end as file_name,
      case when event_id % 97 = 0 then '1998:01:01 00:00:00'
        when event_id % 4 = 0 then strftime(ts + interval 8 hours, '%Y:%m:%d %H:%M:%S')
        when event_id % 4 = 1 then 'bad'
        when event_id % 4 = 3 then strftime(ts + interval 8 hours + interval 3 days, '%Y:%m:%d %H:%M:%S') end as tag
    from events"""
_A = r"(\d{4})[-_]?(\d{2})[-_]?(\d{2})[-_T](\d{2})[-_:](\d{2})[-_:](\d{2})"
_B = r"(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})"
_name_of = lambda p: f"case when regexp_matches(file_name, '{p}') and cast(regexp_extract(file_name, '{p}', 1) as int) between 2000 and 2100 then try_strptime(regexp_extract(file_name, '{p}', 1) || regexp_extract(file_name, '{p}', 2) || regexp_extract(file_name, '{p}', 3) || regexp_extract(file_name, '{p}', 4) || regexp_extract(file_name, '{p}', 5) || regexp_extract(file_name, '{p}', 6), '%Y%m%d%H%M%S') end"
#: With columns t(task_id, file_id, file_name, has_exif, exif_time, named, modified) and the best time and its source.
EVENT_TIMES = f"""
    select *, coalesce(exif_time, named, modified) as best_time,
      case when exif_time is not null then 'exif' when named is not null then 'filename' else 'fs' end as time_source
    from (select task_id, file_id, file_name, tag is not null as has_exif, try_strptime(tag, '%Y:%m:%d %H:%M:%S') - interval 8 hours as exif_time,
        coalesce({_name_of(_A)}, {_name_of(_B)}) - interval 8 hours as named, file_modified - interval 8 hours as modified from ({EVENT_FILES}))"""


def anomaly_sql(best: str = "best_time", exif: str = "exif_time", has: str = "has_exif") -> str:
    return f"""nullif(concat_ws(',', case when not {has} then 'no_exif' end,
        case when {best} > timestamp '{NOW}' + interval 1 day then 'future_time' end, case when {best} < timestamp '2000-01-01' then 'too_old' end,
        case when abs(epoch_us({exif}) - epoch_us(modified)) > 86400000000 then 'exif_fs_mismatch' end), '')"""


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter(
        "event_type in ('view', 'click') and ts >= timestamp_ntz '2024-01-01 06:00:00' and ts < timestamp_ntz '2024-01-30 00:00:00'"
    ).selectExpr("1L as task_id", "cast(event_type = 'click' as int) as source_rank", "event_id as point_seq", "ts", "value / 10 as lat", "user_id / 10 as lng")


TRACK_POINTS = """select 1 as task_id, cast(event_type = 'click' as int) as source_rank, event_id as point_seq, ts, value / 10 as lat, user_id / 10 as lng
    from events where event_type in ('view', 'click') and ts >= timestamp '2024-01-01 06:00:00' and ts < timestamp '2024-01-30 00:00:00'"""


def track_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events, points' own times for exact hits, and a task without any point."""
    e = table(spark, sf_dir, "events")
    own = e.filter("event_type = 'error'").selectExpr("1L as task_id", "event_id as file_id", "ts")
    hit = track_points(spark, sf_dir).filter("point_seq % 50 = 0").selectExpr("1L as task_id", "point_seq as file_id", "ts")
    lost = e.filter("event_type = 'purchase'").selectExpr("2L as task_id", "event_id as file_id", "ts")
    return own.unionByName(hit).unionByName(lost)


TRACK_PHOTOS = f"""select 1 as task_id, event_id as file_id, ts from events where event_type = 'error'
    union all select 1, point_seq, ts from ({TRACK_POINTS}) where point_seq % 50 = 0
    union all select 2, event_id, ts from events where event_type = 'purchase'"""


def preference_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label rows with fixed scores; the user's label is hidden for one in three."""
    score = "((doc_id * 37) % 101) / 100.0D"
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id as file_id", "1L as task_id", "case when doc_id % 3 != 0 then if(quality = 1, 'keep', 'delete') end as user_label",
        f"if({score} > 0.5, 'keep', 'delete') as ai_prediction", f"abs({score} - 0.5) * 2 as ai_confidence", f"{score} as ai_raw_score",
    )


PREFERENCE_ROWS = """select doc_id as file_id, 1 as task_id, case when doc_id % 3 != 0 then case when quality = 1 then 'keep' else 'delete' end end as user_label,
    case when ((doc_id * 37) % 101) / 100.0 > 0.5 then 'keep' else 'delete' end as ai_prediction,
    abs(cast(((doc_id * 37) % 101) / 100.0 as double) - 0.5) * 2 as ai_confidence, cast(((doc_id * 37) % 101) / 100.0 as double) as ai_raw_score from labels"""
