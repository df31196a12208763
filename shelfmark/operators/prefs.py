"""Keep-or-delete preferences: training sets, splits, models, scoring, upserts, versions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from shelfmark.scratch import staged


def confidence(p: Column) -> Column:
    return F.abs(p - 0.5) * 2


def prediction(p: Column) -> Column:
    """Keep above, not at, one half."""
    return F.when(p > 0.5, "keep").otherwise("delete")


def effective(rows: DataFrame) -> DataFrame:
    """Adds ``effective_label, is_corrected, tier``; tiers overlap at their bounds, the higher one is taken."""
    c = F.col("ai_confidence")
    return rows.withColumns(
        {
            "effective_label": F.coalesce("user_label", "ai_prediction"),
            "is_corrected": F.coalesce(F.col("user_label") != F.col("ai_prediction"), F.lit(False)),
            "tier": F.when(c >= 0.8, "high").when(c >= 0.3, "medium").when(c.isNotNull(), "low"),
        }
    )


def training_set(features: DataFrame, labels: DataFrame) -> DataFrame:
    """``file_id, features, label`` (1 keep, 0 delete), joined on the file alone."""
    known = labels.filter("user_label in ('keep', 'delete')").select("file_id", (F.col("user_label") == "keep").cast("int").alias("label"))
    return features.filter("embedding is not null").join(known, "file_id").select("file_id", F.col("embedding").alias("features"), "label")


def split(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Adds ``is_validation``: per class max(1, n div 5) rows in the order of a seeded hash.

    Rows are ranked inside 65,536 ranges of the hash; running sums of the ranges' counts, a small table, give the rest.
    """
    rows = rows.withColumn("_draw", F.xxhash64("file_id", F.lit(seed))).withColumn("_range", F.shiftright("_draw", 48))
    counts = rows.groupBy("label", "_range").agg(F.count("*").alias("_c"))
    of_class = Window.partitionBy("label")
    before = F.sum("_c").over(of_class.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("label", "_range", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_c").over(of_class).alias("_n"))
    nth = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_draw", "file_id"))
    out = rows.withColumn("_nth", nth).join(counts, ["label", "_range"])
    last = F.greatest(F.lit(1), F.expr("_n div 5"))
    return out.withColumn("is_validation", F.col("_before") + F.col("_nth") <= last).drop("_draw", "_range", "_nth", "_before", "_n")


def ready(rows: DataFrame, least: int = 200) -> None:
    """Raises unless there are enough rows and both classes."""
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if sum(n.values()) < least or len(n) < 2:
        raise ValueError(f"{sum(n.values())} labelled rows in {len(n)} classes; {least} rows of both classes are needed")


def weighted(rows: DataFrame) -> DataFrame:
    """Adds ``weight``, the inverse of the class size scaled to a mean of 1."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return rows.join(F.broadcast(n), "label").join(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def resampled(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Rows of the smaller class repeated to the larger one's size, by a seeded draw of the remainder."""
    n = rows.groupBy("label").agg(F.count("*").alias("_n"))
    most = n.agg(F.max("_n").alias("_m"))
    out = rows.join(F.broadcast(n), "label").join(F.broadcast(most))
    times = F.expr("cast(_m div _n as int)") + (F.pmod(F.xxhash64("file_id", F.lit(seed)), F.col("_n")) < F.expr("_m % _n")).cast("int")
    return out.withColumn("_r", F.explode(F.sequence(F.lit(1), times))).drop("_n", "_m", "_r")


def train(rows: DataFrame, kind: str = "logistic", hidden: int = 256, gamma: float = 2.0, rounds: int = 2, seed: int = 42) -> PipelineModel:
    """A fitted pipeline on ``vector``. ``logistic`` is refitted with focal weights; ``network`` has one hidden layer.

    The network is MLlib's: sigmoid units and cross-entropy with L-BFGS, without dropout or early stopping.
    """
    if kind == "network":
        data = resampled(rows, seed).withColumn("vector", array_to_vector(F.transform("features", lambda x: x.cast("double"))))
        width = len(data.first()["vector"])
        return Pipeline(stages=[MultilayerPerceptronClassifier(featuresCol="vector", labelCol="label", layers=[width, hidden, 2], maxIter=50, seed=seed)]).fit(data)
    features = F.transform("features", lambda x: x.cast("double")).alias("features")
    data, model = weighted(rows).select("label", F.col("weight").alias("base"), "weight", features), None
    for _ in range(rounds + 1):
        if model is not None:
            p = _logistic(model.stages[-1], F.col("features"))
            p = F.when(F.col("label") == 1, p).otherwise(1 - p)
            data = data.withColumn("weight", F.col("base") * F.pow(1 - p, F.lit(gamma)) + 1e-6)
        data = _with_vectors(data)  # what the next fit reads over and over
        model = Pipeline(stages=[LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=50, regParam=0.01)]).fit(data)
        data = data.drop("vector")
    return model


def _with_vectors(data: DataFrame) -> DataFrame:
    """Staged rows with ``vector``, which is stored as its fields and read as a vector, without a function of MLlib's."""
    dense = {"type": F.lit(1), "size": F.lit(None), "indices": F.lit(None)}
    vector = F.struct(*(dense[f.name].cast(f.dataType).alias(f.name) if f.name in dense else F.col("features").alias(f.name) for f in VectorUDT.sqlType()))
    schema = StructType([*data.schema.fields, StructField("vector", VectorUDT())])
    return staged(data.withColumn("vector", vector), "training", schema=schema)


def _logistic(model: LogisticRegressionModel, features: Column) -> Column:
    """The probability of class 1 from the model's coefficients, as an expression of Spark's own."""
    products = F.zip_with(features, F.array(*map(F.lit, model.coefficients.toArray().tolist())), lambda x, c: x.cast("double") * c)
    return 1 / (1 + F.exp(-(F.aggregate(products, F.lit(0.0), lambda a, x: a + x) + model.intercept)))


def batch_score(model: PipelineModel, features: DataFrame, version: int) -> DataFrame:
    """``file_id, ai_raw_score, ai_prediction, ai_confidence, model_version`` for every row with a feature, labelled or not."""
    rows, p = features.filter("embedding is not null"), F.col("ai_raw_score")
    if isinstance(model.stages[-1], LogisticRegressionModel):
        out = rows.withColumn("ai_raw_score", _logistic(model.stages[-1], F.col("embedding")))
    else:
        rows = rows.withColumn("vector", array_to_vector(F.transform("embedding", lambda x: x.cast("double"))))
        out = model.transform(rows).withColumn("ai_raw_score", vector_to_array("probability")[1])
    return out.select("file_id", "ai_raw_score", prediction(p).alias("ai_prediction"), confidence(p).alias("ai_confidence"), F.lit(version).alias("model_version"))


def upsert_labels(old: DataFrame, new: DataFrame) -> DataFrame:
    """New user labels over old rows, newest last by ``labeled_at``; predictions of the row stay as they are.

    A label older than the row's own changes nothing, so labels may come twice or late.
    """
    latest = new.groupBy("file_id", "task_id").agg(F.max_by(F.struct("user_label", "labeled_at"), "labeled_at").alias("u"))
    out = old.join(latest, ["file_id", "task_id"], "full")
    out = out.withColumn("u", F.when(F.col("labeled_at").isNull() | (F.col("u.labeled_at") >= F.col("labeled_at")), F.col("u")))
    return out.withColumns(
        {
            "user_label": F.when(F.col("u").isNotNull(), F.col("u.user_label")).otherwise(F.col("user_label")),
            "labeled_at": F.coalesce("u.labeled_at", "labeled_at"),
            "label_source": F.when(F.col("u").isNotNull(), "manual").otherwise(F.col("label_source")),
        }
    ).drop("u")


def upsert_predictions(old: DataFrame, new: DataFrame) -> DataFrame:
    """New predictions over old rows; the user's half of the row stays as it is."""
    cols = ["ai_prediction", "ai_confidence", "ai_raw_score", "model_version"]
    fresh = new.select("file_id", "task_id", *[F.col(c).alias("n_" + c) for c in cols], F.lit(True).alias("_new"))
    out = old.join(fresh, ["file_id", "task_id"], "full")
    return out.withColumns({c: F.when(F.col("_new"), F.col("n_" + c)).otherwise(F.col(c)) for c in cols}).drop("_new", *["n_" + c for c in cols])


def review(files: DataFrame, labels: DataFrame) -> DataFrame:
    """Files with their label rows on file and task, effective label and tier included."""
    return effective(files.join(labels, ["file_id", "task_id"], "left"))


def filtered(rows: DataFrame, prediction: str | None = None, low: float | None = None, high: float | None = None, state: str | None = None) -> DataFrame:
    """Review filters; ``state`` is labeled, unlabeled or corrected, confidence bounds are inclusive."""
    if prediction:
        rows = rows.filter(F.col("ai_prediction") == prediction)
    if low is not None:
        rows = rows.filter(F.col("ai_confidence") >= low)
    if high is not None:
        rows = rows.filter(F.col("ai_confidence") <= high)
    states = {"labeled": "user_label is not null", "unlabeled": "user_label is null", "corrected": "user_label != ai_prediction"}
    return rows.filter(states[state]) if state else rows


def register_version(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """Appends a row with the next version and makes it the only current one."""
    last = registry.agg(F.coalesce(F.max("version"), F.lit(0)).alias("_last"))
    new = entry.join(F.broadcast(last)).withColumns({"version": F.col("_last") + 1, "is_current": F.lit(True)}).drop("_last")
    return registry.withColumn("is_current", F.lit(False)).unionByName(new)


def retain(registry: DataFrame, most: int = 15) -> DataFrame:
    """The newest versions; a top-k, not a window over all."""
    return registry.orderBy(F.desc("version")).limit(most)


def rollback(registry: DataFrame, version: int) -> DataFrame:
    """Points to another version; unknown versions leave the registry as it is."""
    known = registry.filter(F.col("version") == version).agg((F.count("*") > 0).alias("_known"))
    return registry.join(F.broadcast(known)).withColumn("is_current", F.when(F.col("_known"), F.col("version") == version).otherwise(F.col("is_current"))).drop("_known")
