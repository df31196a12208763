"""Similar groups, preferences and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions.fingerprint import difference_hash, ring_hash, unit_length
from shelfmark.operators import dedup, paging, prefs, similar, stats
from shelfmark.plans import actions
from shelfmark.queries import recipes as r
from shelfmark.queries.catalog import MEMBERS
from shelfmark.scratch import staged

#: The fixture's hashes are far apart, so wider thresholds than the defaults are used on it.
LEVELS = {"loose": 12, "standard": 16, "strict": 20}


def _hashes(s, d):
    return r.table(s, d, "embeddings").select(F.lit(1).cast("long").alias("task_id"), F.col("vec_id").alias("file_id"), ring_hash(F.col("embedding")).alias("h"))


def difference_hashes(s, d):
    """Bits of 8 x 9 grids made from the vectors."""
    pixel = lambda i: F.floor(F.get("embedding", i % 64) * F.lit(1000.0)).cast("int") + F.floor(i / 64).cast("int")
    grid = F.transform(F.sequence(F.lit(0), F.lit(71)), pixel)
    return r.table(s, d, "embeddings").select("vec_id", F.lpad(F.bin(difference_hash(grid)), 64, "0").alias("bits"))


def sim_pairs(s, d):
    return similar.edges(_hashes(s, d), 16).select("src", "dst", "distance")


def sim_groups(s, d):
    return similar.similar_groups(_hashes(s, d), 16).select("group_id", "file_id")


def threshold_sweep(s, d):
    return similar.sweep(_hashes(s, d), LEVELS)


def _exact_of_vectors(s, d):
    """Stands for an exact run on the same files: members are those with a vector whose id is even, all in one group."""
    return r.table(s, d, "embeddings").filter("vec_id % 2 = 0").selectExpr("1L as task_id", "0L as group_id", "vec_id as file_id")


def sim_groups_filtered(s, d):
    groups = staged(similar.similar_groups(_hashes(s, d), 16), "similar")
    return dedup.uncovered(groups, _exact_of_vectors(s, d)).select("group_id", "file_id")


def dup_summary(s, d):
    groups = staged(similar.similar_groups(_hashes(s, d), 16), "similar")
    return dedup.summary(_exact_of_vectors(s, d), groups)


def _vector_files(s, d):
    return r.table(s, d, "embeddings").selectExpr("vec_id as file_id", "vec_id * 37 % 11 as file_size", "vec_id % 3 = 0 as has_exif", "'/v/' || vec_id as file_path")


def dup_group_table(s, d):
    """Exact groups of documents and similar groups of vectors, as one run shows them."""
    exact = dedup.exact_members(r.document_files(s, d), r.document_content(s, d))
    similar_ = dedup.recommended(similar.similar_groups(_hashes(s, d), 16), _vector_files(s, d))
    return dedup.group_table(exact, similar_).drop("task_id")


def _text_hashes(s, d):
    return similar.simhashes(r.table(s, d, "documents").select(F.lit(1).cast("long").alias("task_id"), F.col("doc_id").alias("file_id"), "text"))


def near_text_groups(s, d):
    """Similar groups of documents at the loosest default threshold."""
    return similar.similar_groups(_text_hashes(s, d), similar.threshold("loose")).select("group_id", "file_id")


def near_text_uncovered(s, d):
    """Similar groups of documents that an exact run on the same documents does not cover."""
    groups = staged(similar.similar_groups(_text_hashes(s, d), similar.threshold("loose")), "similar")
    return dedup.uncovered(groups, dedup.exact_members(r.document_files(s, d), r.document_content(s, d))).select("group_id", "file_id")


def near_text_summary(s, d):
    """Groups and files of an exact run and of the similar groups that are left beside it."""
    exact = staged(dedup.exact_members(r.document_files(s, d), r.document_content(s, d)).select("task_id", "group_id", "file_id"), "exact")
    groups = staged(similar.similar_groups(_text_hashes(s, d), similar.threshold("loose")), "similar")
    return dedup.summary(exact, dedup.uncovered(groups, exact))


def default_levels(s, d):
    """Groups and files at the default thresholds, 4, 8 and 12."""
    return similar.sweep(_hashes(s, d), similar.LEVELS)


def unit_vector_parts(s, d):
    v = r.table(s, d, "embeddings").select("vec_id", F.posexplode(unit_length(F.col("embedding"))).alias("i", "x"))
    return v.select("vec_id", "i", (F.round("x", 4) + 0.0).alias("x"))


def scored_predictions(s, d):
    """Prediction and confidence from fixed raw scores."""
    rows = r.table(s, d, "labels").selectExpr("doc_id as file_id", "((doc_id * 37) % 101) / 100.0D as p")
    return rows.select("file_id", prefs.prediction(F.col("p")).alias("ai_prediction"), F.round(prefs.confidence(F.col("p")), 6).alias("ai_confidence"))


def class_weights(s, d):
    return prefs.weighted(training_rows(s, d)).select("file_id", F.round("weight", 6).alias("weight"))


def resampled_classes(s, d):
    """Rows of both classes after the smaller one is repeated: how many, and the fewest and most copies of one row, kept within bounds."""
    copies = prefs.resampled(training_rows(s, d)).groupBy("label", "file_id").agg(F.count("*").alias("n"))
    return copies.groupBy("label").agg(F.count("*").alias("files"), F.min("n").alias("least"), (F.max("n") - F.min("n") <= 1).alias("even"))


def review_corrected(s, d):
    """Corrected rows up to a confidence."""
    rows = prefs.effective(r.preference_rows(s, d))
    return prefs.filtered(rows, high=0.7, state="corrected").select("file_id", "user_label", "ai_prediction")


def unit_vectors(s, d):
    v = r.table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * 3).alias("v"))
    return v.select("vec_id", F.round(F.aggregate(unit_length(F.col("v")), F.lit(0.0), lambda a, x: a + x * x), 6).alias("squares"))


def _labels(s, d):
    return r.table(s, d, "labels").selectExpr("doc_id as file_id", "1L as task_id", "if(quality = 1, 'keep', 'delete') as user_label")


def training_rows(s, d):
    return prefs.training_set(r.table(s, d, "embeddings").selectExpr("vec_id as file_id", "embedding"), _labels(s, d))


def label_stats(s, d):
    return stats.label_stats(training_rows(s, d).select(F.when(F.col("label") == 1, "keep").otherwise("delete").alias("user_label")))


def training_set(s, d):
    return training_rows(s, d).select("file_id", "label", F.size("features").alias("width"))


def stratified_split(s, d):
    return prefs.split(training_rows(s, d)).groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_validation").alias("validation"))


def review_page(s, d):
    rows = prefs.effective(r.preference_rows(s, d))
    rows = prefs.filtered(rows, prediction="keep", low=0.3, state="labeled")
    return paging.page(rows, "ai_confidence", "file_id", size=40).select("file_id", "effective_label", "is_corrected", "tier", F.round("ai_confidence", 6).alias("ai_confidence"))


def uncertain_first(s, d):
    return paging.page(prefs.filtered(r.preference_rows(s, d), state="unlabeled"), "ai_confidence", "file_id", size=30).select("file_id", "ai_prediction")


def review_join(s, d):
    """All documents with their label rows, unlabelled ones included."""
    files = r.document_files(s, d).select("file_id", "task_id", "file_path")
    return prefs.review(files, r.preference_rows(s, d)).select("file_id", "effective_label", "is_corrected", "tier")


def effective_label_stats(s, d):
    return stats.effective_stats(r.preference_rows(s, d))


def ai_delete_plan(s, d):
    return actions.delete_by_labels(r.document_files(s, d), r.preference_rows(s, d)).select("file_id", "file_size")


def ai_delete_freed(s, d):
    return stats.freed(actions.delete_by_labels(r.document_files(s, d), r.preference_rows(s, d)))


def ai_delete_rest(s, d):
    """Label rows left once the plan has been carried out."""
    rows = r.preference_rows(s, d)
    return actions.without(rows, actions.delete_by_labels(r.document_files(s, d), rows)).select("file_id", "user_label", "ai_prediction")


def label_upsert(s, d):
    old = r.preference_rows(s, d).withColumns({"labeled_at": F.lit("2024-01-01").cast("timestamp_ntz"), "label_source": F.lit("manual")})
    new = r.table(s, d, "events").filter("event_type in ('view', 'click')").selectExpr("user_id as file_id", "1L as task_id", "if(event_type = 'view', 'keep', 'delete') as user_label", "ts as labeled_at")
    return prefs.upsert_labels(old, new).select("file_id", "user_label", "ai_prediction", "label_source")


def prediction_upsert(s, d):
    old = r.preference_rows(s, d).withColumn("model_version", F.lit(1))
    new = r.table(s, d, "embeddings").selectExpr("vec_id as file_id", "1L as task_id", "'keep' as ai_prediction", "0.5D as ai_confidence", "0.75D as ai_raw_score", "2 as model_version")
    return prefs.upsert_predictions(old, new).select("file_id", "user_label", "ai_prediction", "model_version")


def model_metrics(s, d):
    out = stats.metrics(r.preference_rows(s, d).filter("user_label is not null"), "user_label", "ai_prediction")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


def train_score(s, d):
    """Scores of all vectors by a model fitted on the training part of the labelled ones."""
    labelled = training_rows(s, d)
    prefs.ready(labelled, 50)  # the smallest tables hold fewer than the usual 200
    rows = prefs.split(labelled).filter("not is_validation")
    model = prefs.train(rows)
    return prefs.batch_score(model, r.table(s, d, "embeddings").selectExpr("vec_id as file_id", "embedding"), 1)


def _registry(s, d):
    """One version per day of events, its samples the day's events."""
    days = r.table(s, d, "events").groupBy(F.dayofmonth("ts").alias("version")).agg(F.count("*").alias("training_samples"))
    return days.withColumn("is_current", F.col("version") == 30)


def model_registry(s, d):
    new = r.table(s, d, "events").agg(F.count("*").alias("training_samples"))
    return prefs.retain(prefs.register_version(_registry(s, d), new)).select("version", "training_samples", "is_current")


def model_rollback(s, d):
    return prefs.rollback(_registry(s, d), 12).select("version", "is_current")


_CODE = "array_to_string([" + ", ".join(f"case when embedding[{i + 1}] > embedding[{(i + 1) % 64 + 1}] then '1' else '0' end" for i in range(64)) + "], '')"
_REPS = f"select min(vec_id) as id, code from (select vec_id, {_CODE} as code from embeddings) group by code"
_PAIRS = "select a.id as src, b.id as dst, hamming(a.code, b.code)::int as distance from reps a join reps b on a.id < b.id and hamming(a.code, b.code) <= %d"


def _closure(t: int) -> str:
    return f"""with recursive reps as materialized ({_REPS}), e as materialized ({_PAIRS % t}),
        sym as (select src as a, dst as b from e union all select dst, src from e union all select id, id from reps),
        walk(a, b) as (select a, b from sym union select w.a, s.b from walk w join sym s on w.b = s.a),
        comp as (select a as id, min(b) as group_id from walk group by a),
        files as (select vec_id as file_id, group_id from (select vec_id, {_CODE} as code from embeddings) v join reps using (code) join comp using (id)),
        grp as (select * from files qualify count(*) over (partition by group_id) >= 2)"""


_SIMHASH = """tokens as (select doc_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\n\\t\\r]+'), lambda t: t != '')) as t from documents),
        sums as (select doc_id, i, sum(2 * cast(substr(h, i + 1, 1) as int) - 1) as n
                 from (select doc_id, to_base(cast('0x' || substr(md5(t), 1, 8) as bigint), 2, 32) || to_base(cast('0x' || substr(md5(t), 9, 8) as bigint), 2, 32) as h from tokens) x, range(64) r(i) group by 1, 2),
        codes as materialized (select doc_id, coalesce(code, repeat('0', 64)) as code from documents left join
                 (select doc_id, string_agg(case when n > 0 then '1' else '0' end, '' order by i) as code from sums group by 1) c using (doc_id))"""
_TEXT_GROUPS = f"""with recursive {_SIMHASH},
        reps as materialized (select min(doc_id) as id, code from codes group by code),
        e as materialized (select a.id as src, b.id as dst from reps a join reps b on a.id < b.id and hamming(a.code, b.code) <= 4),
        sym as (select src as a, dst as b from e union all select dst, src from e union all select id, id from reps),
        walk(a, b) as (select a, b from sym union select w.a, s.b from walk w join sym s on w.b = s.a),
        comp as (select a as id, min(b) as group_id from walk group by a),
        grp as (select group_id, doc_id as file_id from codes join reps using (code) join comp using (id) qualify count(*) over (partition by group_id) >= 2)"""
_P = f"({r.PREFERENCE_ROWS})"
#: The labelled rows that have a vector.
SELECTED = "(select doc_id as file_id, quality as label from labels join embeddings on doc_id = vec_id)"
_REG = "(select day(ts) as version, count(*) as training_samples from events group by 1)"
_DELETE = f"select f.* from ({r.DOCUMENT_FILES}) f join {_P} p using (file_id) where user_label = 'delete' or (ai_prediction = 'delete' and user_label is null)"
_TIER = "case when ai_confidence >= 0.8 then 'high' when ai_confidence >= 0.3 then 'medium' when ai_confidence is not null then 'low' end"
_WRONG = "coalesce(user_label != ai_prediction, false)"

QUERIES = {f.__name__: f for f in (
    difference_hashes, sim_pairs, sim_groups, threshold_sweep, sim_groups_filtered, dup_summary, unit_vectors, dup_group_table, near_text_groups, near_text_uncovered, near_text_summary, default_levels, unit_vector_parts, scored_predictions,
    class_weights, resampled_classes, review_corrected, label_stats, training_set, stratified_split, review_page, uncertain_first,
    review_join, effective_label_stats, ai_delete_plan, ai_delete_freed, ai_delete_rest, label_upsert, prediction_upsert, model_metrics, train_score,
    model_registry, model_rollback,
)}

ORACLE_SQL = {
    "difference_hashes": """with p as (select vec_id, [cast(floor(embedding[i % 64 + 1] * 1000.0::double) as int) + i // 64 for i in range(72)] as p from embeddings)
        select vec_id, array_to_string([case when p[i + i // 8 + 1] > p[i + i // 8 + 2] then '1' else '0' end for i in range(64)], '') as bits from p""",
    "sim_pairs": f"with reps as ({_REPS}) {_PAIRS % 16}",
    "sim_groups": f"{_closure(16)} select group_id, file_id from grp",
    "threshold_sweep": " union all ".join(f"(select * from ({_closure(t)} select '{n}' as level, {t} as threshold, count(distinct group_id) as groups, count(*) as files from grp))" for n, t in LEVELS.items()),
    "sim_groups_filtered": f"{_closure(16)} select group_id, file_id from grp qualify not bool_and(file_id % 2 = 0) over (partition by group_id)",
    "dup_summary": f"{_closure(16)} select count(distinct group_id) as groups, count(*) as files, 'similar' as kind from grp union all select 1, count(*), 'exact' from embeddings where vec_id % 2 = 0",
    "dup_group_table": f"""{_closure(16)}, m as ({MEMBERS}) select group_id, count(*) as file_count, max(case when is_recommended then file_id end) as recommended_keep_id,
        'exact' as group_type, 1.0::double as similarity from m group by 1 union all
        select -1 - group_id, count(*), arg_min(file_id, {{'a': -(file_id * 37 % 11), 'b': file_id % 3 != 0, 'c': length('/v/' || file_id), 'd': file_id}}), 'similar', null from grp group by 1""",
    "near_text_groups": f"{_TEXT_GROUPS} select group_id, file_id from grp",
    "near_text_uncovered": f"{_TEXT_GROUPS}, m as ({MEMBERS}) select group_id, file_id from grp qualify not bool_and(file_id in (select file_id from m)) over (partition by group_id)",
    "near_text_summary": f"""{_TEXT_GROUPS}, m as ({MEMBERS}), u as (select * from grp qualify not bool_and(file_id in (select file_id from m)) over (partition by group_id))
        select count(distinct group_id) as groups, count(*) as files, 'exact' as kind from m union all select count(distinct group_id), count(*), 'similar' from u""",
    "default_levels": " union all ".join(f"(select * from ({_closure(t)} select '{n}' as level, {t} as threshold, count(distinct group_id) as groups, count(*) as files from grp))" for n, t in similar.LEVELS.items()),
    "unit_vector_parts": """select vec_id, cast(i as int) as i, round(x / sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 4) + 0.0 as x
        from (select vec_id, embedding, unnest(embedding)::double as x, generate_subscripts(embedding, 1) - 1 as i from embeddings)""",
    "scored_predictions": """select file_id, case when p > 0.5 then 'keep' else 'delete' end as ai_prediction, round(abs(p - 0.5::double) * 2, 6) as ai_confidence
        from (select doc_id as file_id, ((doc_id * 37) % 101) / 100.0::double as p from labels)""",
    "class_weights": f"""select file_id, round((select count(*) from {SELECTED}) / ((select count(distinct label) from {SELECTED}) * count(*) over (partition by label))::double, 6) as weight from {SELECTED}""",
    "resampled_classes": f"""select cast(label as int) as label, n as files, m // n as least, true as even
        from (select *, max(n) over () as m from (select label, count(*) as n from {SELECTED} group by 1))""",
    "review_corrected": f"select file_id, user_label, ai_prediction from {_P} where user_label != ai_prediction and ai_confidence <= 0.7",
    "unit_vectors": "select vec_id, 1.0::double as squares from embeddings",
    "label_stats": f"""select count(*) as total, count(*) filter (where label = 1) as keep, count(*) filter (where label = 0) as delete,
        count(*) >= 200 and count(*) filter (where label = 1) > 0 and count(*) filter (where label = 0) > 0 as ready from {SELECTED}""",
    "training_set": f"select file_id, cast(label as int) as label, 64 as width from {SELECTED}",
    "stratified_split": f"select cast(label as int) as label, count(*) as n, greatest(1, count(*) // 5) as validation from {SELECTED} group by 1",
    "review_page": f"""select file_id, coalesce(user_label, ai_prediction) as effective_label, {_WRONG} as is_corrected, {_TIER} as tier, round(ai_confidence, 6) as ai_confidence
        from {_P} where ai_prediction = 'keep' and ai_confidence >= 0.3 and user_label is not null order by ai_confidence nulls first, file_id limit 40""",
    "uncertain_first": f"select file_id, ai_prediction from {_P} where user_label is null order by ai_confidence nulls first, file_id limit 30",
    "review_join": f"""select f.file_id, coalesce(user_label, ai_prediction) as effective_label, {_WRONG} as is_corrected, {_TIER} as tier
        from ({r.DOCUMENT_FILES}) f left join {_P} p on f.file_id = p.file_id and f.task_id = p.task_id""",
    "effective_label_stats": f"""select count(*) as total, count(*) filter (where coalesce(user_label, ai_prediction) = 'keep') as keep,
        count(*) filter (where coalesce(user_label, ai_prediction) = 'delete') as delete, count(*) filter (where {_WRONG}) as corrected from {_P}""",
    "ai_delete_plan": f"select file_id, file_size from ({_DELETE})",
    "ai_delete_freed": f"select count(*) as deleted, cast(coalesce(sum(file_size), 0) as bigint) as bytes from ({_DELETE})",
    "ai_delete_rest": f"select file_id, user_label, ai_prediction from {_P} where not coalesce(user_label = 'delete' or (ai_prediction = 'delete' and user_label is null), false)",
    "label_upsert": f"""with n as (select user_id as file_id, arg_max(case when event_type = 'view' then 'keep' else 'delete' end, ts) as u from events where event_type in ('view', 'click') group by 1)
        select coalesce(p.file_id, n.file_id) as file_id, coalesce(u, user_label) as user_label, ai_prediction, 'manual' as label_source from {_P} p full join n on p.file_id = n.file_id""",
    "prediction_upsert": f"""select coalesce(p.file_id, vec_id) as file_id, user_label, case when vec_id is not null then 'keep' else ai_prediction end as ai_prediction,
        case when vec_id is not null then 2 else 1 end as model_version from {_P} p full join embeddings on p.file_id = vec_id""",
    "model_metrics": f"""with c as (select count(*)::double as n, count(*) filter (where t and g)::double as tp, count(*) filter (where not t and g)::double as fp,
            count(*) filter (where t and not g)::double as fn, count(*) filter (where t = g)::double as ok from (select user_label = 'keep' as t, ai_prediction = 'keep' as g from {_P} where user_label is not null)),
        m as (select ok / greatest(n, 1) as accuracy, tp / greatest(tp + fp, 1) as p, tp / greatest(tp + fn, 1) as r from c)
        select round(accuracy, 6) as accuracy, round(p, 6) as precision, round(r, 6) as recall, round(2 * p * r / greatest(p + r, 1e-8), 6) as f1 from m""",
    "model_registry": f"""select * from (select version, training_samples, false as is_current from {_REG} union all
        select (select max(version) + 1 from {_REG}), (select count(*) from events), true) order by version desc limit 15""",
    "model_rollback": f"select version, version = 12 as is_current from {_REG}",
}
