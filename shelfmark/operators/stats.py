"""Catalog, label and result statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ["image", "video", "raw", "other"]


def count_by_type(files: DataFrame) -> DataFrame:
    """``file_type, n`` with a row for each type, 0 where there is none."""
    kinds = files.sparkSession.createDataFrame([(t,) for t in TYPES], "file_type string")
    return kinds.join(files.groupBy("file_type").agg(F.count("*").alias("n")), "file_type", "left").select("file_type", F.coalesce("n", F.lit(0)).alias("n"))


def count_by_extension(files: DataFrame) -> DataFrame:
    """``extension, n, percent``; files without one as ``(no extension)``. The total comes from the few grouped rows."""
    per = files.groupBy(F.coalesce("extension", F.lit("(no extension)")).alias("extension")).agg(F.count("*").alias("n"))
    total = files.agg(F.count("*").alias("total"))
    share = F.round(F.lit(100.0) * F.col("n") / F.col("total"), 1)
    return per.join(F.broadcast(total)).select("extension", "n", share.alias("percent"))


def task_rollup(files: DataFrame) -> DataFrame:
    """Counters per task; raw files count as other."""
    n = lambda *t: F.count_if(F.col("file_type").isin(*t))
    return files.groupBy("task_id").agg(
        F.count("*").alias("file_count"), n("image").alias("image_count"), n("video").alias("video_count"), n("raw", "other").alias("other_count")
    )


def exif_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("task_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.coalesce("has_exif", F.lit(False))).alias("with_exif"),
        F.count_if(~F.coalesce("has_exif", F.lit(False))).alias("no_exif"),
        F.count("time_anomaly").alias("anomalies"),
    )


def label_stats(labels: DataFrame, least: int = 200) -> DataFrame:
    """Counts of user labels and whether a model can be trained from them."""
    out = labels.filter("user_label is not null").agg(
        F.count("*").alias("total"), F.count_if(F.col("user_label") == "keep").alias("keep"), F.count_if(F.col("user_label") == "delete").alias("delete")
    )
    return out.withColumn("ready", (F.col("total") >= least) & (F.col("keep") > 0) & (F.col("delete") > 0))


def effective_stats(rows: DataFrame) -> DataFrame:
    """Counts of effective labels and corrections."""
    label = F.coalesce("user_label", "ai_prediction")
    wrong = F.coalesce(F.col("user_label") != F.col("ai_prediction"), F.lit(False))
    return rows.agg(
        F.count("*").alias("total"), F.count_if(label == "keep").alias("keep"), F.count_if(label == "delete").alias("delete"), F.count_if(wrong).alias("corrected")
    )


def metrics(rows: DataFrame, truth: str, guess: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of the class ``keep`` in one pass."""
    t, g = F.col(truth) == "keep", F.col(guess) == "keep"
    one = lambda c: F.count_if(c).cast("double")
    out = rows.agg(F.count("*").cast("double").alias("n"), one(t & g).alias("tp"), one(~t & g).alias("fp"), one(t & ~g).alias("fn"), one(t == g).alias("ok"))
    out = out.withColumns({"precision": F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1.0)), "recall": F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1.0))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-8))
    return out.select((F.col("ok") / F.greatest("n", F.lit(1.0))).alias("accuracy"), "precision", "recall", f1.alias("f1"))


def freed(plan: DataFrame) -> DataFrame:
    """Files and bytes of a deletion plan."""
    return plan.agg(F.count("*").alias("deleted"), F.coalesce(F.sum(F.coalesce("file_size", F.lit(0))), F.lit(0)).alias("bytes"))
