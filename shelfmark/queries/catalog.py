"""Duplicates, catalog statistics, pages, directories and deletion plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark.functions import fingerprint, formats
from shelfmark.functions.paths import empty_directories
from shelfmark.operators import dedup, paging, stats
from shelfmark.plans import actions
from shelfmark.queries import recipes as r
from shelfmark.sources import catalog


def _members(s, d):
    return dedup.exact_members(r.document_files(s, d), r.document_content(s, d))


MEMBERS = f"""
    select *, row_number() over (partition by h order by file_size desc, has_exif desc, length(file_path), file_id) = 1 as is_recommended
    from (select *, min(file_id) over (partition by h) as group_id, count(*) over (partition by h) as n
          from (select *, sha256(content) as h from ({r.DOCUMENT_FILES}))) where n >= 2"""
_GROUPS = f"""select group_id, count(*) as file_count, max(case when is_recommended then file_id end) as recommended_keep_id,
    'exact' as group_type, 1.0::double as similarity from ({MEMBERS}) group by group_id"""


def dup_exact_groups(s, d):
    return dedup.groups(_members(s, d), "exact", 1.0).drop("task_id")


def dup_exact_members(s, d):
    return dedup.accept(_members(s, d)).select("group_id", "file_id", "file_size", "is_recommended", "user_action")


def dup_funnel_counts(s, d):
    return dedup.funnel_counts(r.document_files(s, d), r.document_content(s, d))


def dup_reclaimable(s, d):
    return dedup.reclaimable(_members(s, d))


def dup_group_page(s, d):
    return paging.page(dedup.groups(_members(s, d), "exact", 1.0), "file_count", "group_id", descending=True, size=20).select("group_id", "file_count")


def dup_group_total(s, d):
    return paging.total(dedup.groups(_members(s, d), "exact", 1.0))


def dup_delete_plan(s, d):
    files = r.document_files(s, d)
    return actions.delete_duplicates(dedup.accept(_members(s, d)), files).select("file_id", "file_path", "file_size", formats.size_text(F.col("file_size")).alias("size_text"))


def dup_group_details(s, d):
    """All groups with their members' names, one join for all."""
    return _members(s, d).select("group_id", "file_id", "file_path", "is_recommended")


def quick_hash_groups(s, d):
    """Sizes of groups that share a quick hash and a size; the hash itself is engine-specific."""
    rows = r.document_content(s, d).filter("content is not null").withColumn("q", fingerprint.quick_hash(F.col("content")))
    rows = rows.join(r.document_files(s, d).select("file_id", "file_size"), "file_id")
    return rows.groupBy("file_size", "q").agg(F.min("file_id").alias("first_id"), F.count("*").alias("n")).filter("n >= 2").select("first_id", "n")


def scan_by_type(s, d):
    return stats.count_by_type(r.page_files(s, d))


def scan_by_extension(s, d):
    return stats.count_by_extension(r.page_files(s, d))


def scan_classified(s, d):
    return r.page_files(s, d).select("file_id", "file_name", "extension", "file_type", "mime_type")


def task_rollup(s, d):
    return stats.task_rollup(r.page_files(s, d))


def file_page(s, d):
    return paging.page(r.page_files(s, d), "extension", "file_id", number=2, size=25).select("file_id", "file_name", "extension", "file_size")


def file_page_desc(s, d):
    return paging.page(r.page_files(s, d), "extension", "file_id", descending=True, number=9, size=25).select("file_id", "file_name", "extension")


def delete_by_extension_plan(s, d):
    return actions.delete_by_extension(r.page_files(s, d), "JPG").select("file_id", "file_name", "file_size")


def delete_by_extension_freed(s, d):
    return stats.freed(actions.delete_by_extension(r.page_files(s, d), ".jpg"))


def empty_dirs(s, d):
    return empty_directories(r.listing(s, d))


def change_detection(s, d):
    """The catalog of orders against a later one: some gone, some new, some larger, some hashed by an older version."""
    o = r.table(s, d, "orders")
    old = o.filter("o_orderkey % 11 != 0").selectExpr("'/o/' || o_orderkey as file_path", "cast(o_totalprice as bigint) as file_size", "o_orderdate as file_modified", "cast(if(o_orderkey % 13 = 0, 1, 2) as int) as hash_version")
    new = o.filter("o_orderkey % 7 != 0").selectExpr("'/o/' || o_orderkey as file_path", "cast(o_totalprice as bigint) + if(o_orderkey % 5 = 0, 1, 0) as file_size", "o_orderdate as file_modified")
    return catalog.changes(old, new, 2)


def pending_features(s, d):
    """Documents without an embedding yet."""
    done = r.table(s, d, "embeddings").selectExpr("vec_id as file_id")
    return catalog.pending(r.document_files(s, d), done).select("file_id")


def audit_page(s, d):
    log = r.table(s, d, "events").selectExpr("event_id as log_id", "user_id as task_id", "event_type as operation_type", "props as detail", "ts as created_at")
    out = actions.audit_page(log, operation="purchase", number=2, size=50)
    return out.select("log_id", "task_id", "operation_type", F.get_json_object("detail", "$.k").cast("long").alias("k"))


def audit_rows(s, d):
    """Log rows of the extension plan, details read back from their JSON."""
    log = actions.audit(actions.delete_by_extension(r.page_files(s, d), "zip"), "delete_extension", r.now(), "file_id", "file_size")
    return log.select("task_id", "operation_type", "file_path", F.get_json_object("detail", "$.file_id").cast("long").alias("file_id"), F.get_json_object("detail", "$.file_size").cast("long").alias("file_size"))


def organise_plan(s, d):
    files = r.table(s, d, "orders").selectExpr("o_orderkey as file_id", "o_orderdate as best_time", "o_orderpriority || '.jpg' as file_name")
    return actions.organise(files).select("file_id", "target")


def organise_free_names(s, d):
    """Targets among names that bear numbers already: of each priority and month, several files are called ``name-k``."""
    name = "o_orderpriority || case when o_custkey % 3 = 0 then '-' || (o_custkey % 40 + 1) else '' end || case when o_custkey % 2 = 0 then '.jpg' else '' end"
    return actions.organise(r.table(s, d, "orders").selectExpr("o_orderkey as file_id", "o_orderdate as best_time", f"{name} as file_name")).select("file_id", "target")


def _organise_sql(name: str) -> str:
    """Every later file of a target takes the next of all numbers that make no other file's target."""
    return f"""
        with f as (select o_orderkey as file_id, strftime(o_orderdate + interval 8 hours, '%Y/%m/') || {name} as t from orders),
        g as (select *, row_number() over (partition by t order by file_id) - 1 as n from f),
        s as (select t, max(n) as most, regexp_replace(t, '[.]jpg$', '') as stem, case when ends_with(t, '.jpg') then '.jpg' else '' end as ext from g group by t),
        c as (select t, stem || '-' || k || ext as target, k from (select *, unnest(range(1, most + 50)) as k from s where most > 0)),
        free as (select t, target, row_number() over (partition by t order by k) as n from c where target not in (select t from f))
        select file_id, coalesce(target, t) as target from g left join free using (t, n)"""


_PLAN = f"select file_id, file_path, file_size from ({MEMBERS}) where not is_recommended"
_SIZE = """case when file_size is null or file_size = 0 then '-' when file_size < 1024 then file_size || ' B'
    when file_size < 1048576 then format('{:.1f} KB', round(file_size / 1024.0::double, 1)) else format('{:.1f} MB', round(file_size / 1048576.0::double, 1)) end"""
_DIRS = """
    p as (select page_id, list_filter(string_split(regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', ''), '/'), lambda x: x != '') as l from pages),
    dirs as (select distinct array_to_string(l[1:i], '/') as path from (select l, unnest(range(1, len(l) + 1)) as i from p)),
    busy as (select distinct array_to_string(l[1:i], '/') as path from (select l, unnest(range(1, len(l) + 1)) as i from p where page_id % 3 = 0))"""

QUERIES = {f.__name__: f for f in (
    dup_exact_groups, dup_exact_members, dup_funnel_counts, dup_reclaimable, dup_group_page, dup_group_total, dup_delete_plan, dup_group_details, quick_hash_groups, scan_by_type,
    scan_by_extension, scan_classified, task_rollup, file_page, file_page_desc, delete_by_extension_plan, delete_by_extension_freed, empty_dirs,
    change_detection, pending_features, audit_page, audit_rows, organise_plan, organise_free_names,
)}

ORACLE_SQL = {
    "dup_group_total": f"select count(*) as total from ({_GROUPS})",
    "dup_exact_groups": _GROUPS,
    "dup_exact_members": f"select group_id, file_id, file_size, is_recommended, case when is_recommended then 'keep' else 'delete' end as user_action from ({MEMBERS})",
    "dup_funnel_counts": f"""
        with f as ({r.DOCUMENT_FILES}), a as (select *, count(*) over (partition by file_size) as n1 from f where file_size is not null),
        b as (select *, count(*) over (partition by file_size, md5(substr(hex(encode(content)), 1, 16384) || case when strlen(content) > 16384 then substr(hex(encode(content)), 2 * strlen(content) - 16383) else '' end)) as n2
              from a where n1 >= 2 and content is not null),
        c as (select *, count(*) over (partition by sha256(content)) as n3 from b where n2 >= 2)
        select 1 as stage, 'size' as name, count(*) as files from a where n1 >= 2
        union all select 2, 'quick', count(*) from b where n2 >= 2 union all select 3, 'full', count(*) from c where n3 >= 2""",
    "dup_reclaimable": f"""select count(*) as groups, cast(coalesce(sum(n), 0) as bigint) as files, cast(coalesce(sum(b), 0) as bigint) as bytes, round(coalesce(sum(b), 0) / 1048576.0, 2) as mb
        from (select count(*) as n, sum(file_size) - max(file_size) as b from ({MEMBERS}) group by group_id)""",
    "dup_group_page": f"select group_id, file_count from ({_GROUPS}) order by file_count desc, group_id limit 20",
    "dup_delete_plan": f"select file_id, file_path, file_size, {_SIZE} as size_text from ({_PLAN})",
    "dup_group_details": f"select group_id, file_id, file_path, is_recommended from ({MEMBERS})",
    "quick_hash_groups": f"""select min(file_id) as first_id, count(*) as n from ({r.DOCUMENT_FILES}) where content is not null
        group by file_size, substr(hex(encode(content)), 1, 16384) || case when strlen(content) > 16384 then substr(hex(encode(content)), 2 * strlen(content) - 16383) else '' end having count(*) >= 2""",
    "scan_by_type": f"""select t.file_type, count(f.file_id) as n from (values ('image'), ('video'), ('raw'), ('other')) t(file_type)
        left join ({r.PAGE_FILES}) f on t.file_type = f.file_type group by 1""",
    "scan_by_extension": f"select coalesce(extension, '(no extension)') as extension, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 1) as percent from ({r.PAGE_FILES}) group by 1",
    "scan_classified": f"select file_id, file_name, extension, file_type, mime_type from ({r.PAGE_FILES})",
    "task_rollup": f"""select task_id, count(*) as file_count, count(*) filter (where file_type = 'image') as image_count,
        count(*) filter (where file_type = 'video') as video_count, count(*) filter (where file_type in ('raw', 'other')) as other_count from ({r.PAGE_FILES}) group by 1""",
    "file_page": f"select file_id, file_name, extension, file_size from ({r.PAGE_FILES}) order by extension asc nulls first, file_id limit 25 offset 25",
    "file_page_desc": f"select file_id, file_name, extension from ({r.PAGE_FILES}) order by extension desc nulls last, file_id limit 25 offset 200",
    "delete_by_extension_plan": f"select file_id, file_name, file_size from ({r.PAGE_FILES}) where extension = '.jpg'",
    "delete_by_extension_freed": f"select count(*) as deleted, cast(coalesce(sum(file_size), 0) as bigint) as bytes from ({r.PAGE_FILES}) where extension = '.jpg'",
    "empty_dirs": f"with {_DIRS} select path, cast(len(string_split(path, '/')) as int) as depth from dirs where path not in (select path from busy)",
    "change_detection": """
        with o as (select '/o/' || o_orderkey as file_path, trunc(o_totalprice)::bigint as sz, case when o_orderkey % 13 = 0 then 1 else 2 end as v from orders where o_orderkey % 11 != 0),
        n as (select '/o/' || o_orderkey as file_path, trunc(o_totalprice)::bigint + case when o_orderkey % 5 = 0 then 1 else 0 end as sz from orders where o_orderkey % 7 != 0)
        select coalesce(o.file_path, n.file_path) as file_path, case when o.sz is null then 'new' when n.sz is null then 'vanished'
            when o.sz = n.sz and v = 2 then 'unchanged' else 'changed' end as change from o full join n on o.file_path = n.file_path""",
    "pending_features": "select doc_id as file_id from documents where doc_id not in (select vec_id from embeddings)",
    "audit_page": """select event_id as log_id, user_id as task_id, event_type as operation_type, cast(json_extract_string(props, '$.k') as bigint) as k
        from events where event_type = 'purchase' order by ts desc, event_id desc limit 50 offset 50""",
    "audit_rows": f"select task_id, 'delete_extension' as operation_type, file_path, file_id, file_size from ({r.PAGE_FILES}) where extension = '.zip'",
    "organise_plan": _organise_sql("o_orderpriority || '.jpg'"),
    "organise_free_names": _organise_sql("o_orderpriority || case when o_custkey % 3 = 0 then '-' || (o_custkey % 40 + 1) else '' end || case when o_custkey % 2 = 0 then '.jpg' else '' end"),
}
