"""The registered queries of this package and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import language_id, packing, toxicity
from shelfmark.llm.decontaminate import contamination
from shelfmark.llm.divergence import SCALE, TERMS, audit
from shelfmark.llm.exact_dedup import exact_dedup
from shelfmark.llm.jaccard_join import near_duplicates
from shelfmark.llm.language_model import score as score_texts
from shelfmark.llm.license_scan import _HOLDER, _VERSION, RULES, SENTENCES, WEAK, _as_list, _known, scan_licenses
from shelfmark.llm.sharding import shard_documents
from shelfmark.llm.source_mixing import mix
from shelfmark.llm.spelling import variants
from shelfmark.llm.substring_dedup import remove_repeats


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses")
    )


def toxicity_network(docs: DataFrame, labels: DataFrame) -> toxicity.Network | None:
    """Fitted on the labelled documents outside the held-out fold (crc32 of the identifier modulo 3 is 1)."""
    return toxicity.fit(docs, labels.filter(language_id.fold(F.col("doc_id"), 3) != 1))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_network(docs, _table(spark, sf_dir, "labels")))
    held_out = (language_id.fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return out.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(language_id.fold(F.col("doc_id"), 3) != 1))
    out = language_id.identify(docs, model)
    return out.select("doc_id", (language_id.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(language_id.fold(F.col("doc_id"), 7) == 2, F.lit(False))
    out = score_texts(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"), least=3, most=TERMS)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(_table(spark, sf_dir, "documents"), least=5, shortest=6, times=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_jaccard_join, op3_license_scan, op4_toxicity, op5_sharding,
        op6_packing, op7_language_id, op8_decontamination, op9_lm_scoring, op10_substring_dedup,
        op11_source_mixing, op12_source_divergence, op13_spelling_variants,
    )
}

_met = lambda ids: f"(contains(j, '{_as_list(ids)}') or contains(k, '{_as_list(ids)}'))"
_RULE_SQL = ", ".join(
    "case when "
    + " and ".join([_met(ids)] + [f"not {_met(o)}" for _, o in RULES if len(o) > len(ids) and _as_list(ids) in _as_list(o)])
    + f" then '{name}' end"
    for name, ids in RULES
)
_KNOWN_SQL = "map {" + ", ".join(f"'{k}': {v}" for k, v in _known(SENTENCES).items()) + "}"
_AZ = "translate(%s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SENTENCES = (
    rf"list_transform(string_split(regexp_replace(regexp_replace(%s, '{_VERSION[0]}', '{_VERSION[1].format(chr(92))}', 'g'), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), "
    + "lambda x: regexp_replace(trim(regexp_replace(" + _AZ % "x" + f", '[^a-z0-9]+', ' ', 'g')), '{_HOLDER[0]}', '{_HOLDER[1]}'))"
)
_IDS = f"list_filter(list_transform(%s, lambda x: ({_KNOWN_SQL})[x]), lambda x: x is not null)"
_W2 = "regexp_extract_all(" + _AZ % "coalesce(text, '')" + r", '[^\x20\x09-\x0D]+')"
_W8 = "regexp_extract_all(" + _AZ % "coalesce(text, '')" + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_W12 = "regexp_extract_all(" + _AZ % "coalesce(text, '')" + r", '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
#: The table of crc32 (reflected polynomial 0xEDB88320), one step of 8 bits an entry.
_CRC_TABLE = functools.reduce(lambda t, _: [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in t], range(8), list(range(256)))
_CRC = (
    "xor(4294967295, list_reduce(list_concat([4294967295::bigint], list_transform(range(1, strlen(%s), 2), lambda i: ('0x' || substr(%s, i, 2))::bigint)), "
    f"lambda c, b: xor(c >> 8, ({_CRC_TABLE}::bigint[])[(xor(c, b) & 255) + 1])))"
)

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        with t as (select doc_id, length(coalesce(text, '')) as n,
                          sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) as h from documents)
        select doc_id, first_value(doc_id) over (partition by h order by n desc, doc_id) as keep_id,
               count(*) over (partition by h) as group_size,
               doc_id = first_value(doc_id) over (partition by h order by n desc, doc_id) as kept, h as text_sha256 from t""",
    "op2_jaccard_join": rf"""
        with recursive d as (select doc_id, {_W2} as w from documents),
        s as (select distinct doc_id, array_to_string(w[i:i + 3], ' ') as g
              from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from d where len(w) > 0)),
        n as (select doc_id, count(*) as n from s group by 1),
        c as (select a.doc_id as x, b.doc_id as y, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
        l as (select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * c >= 85 * (a.n + b.n - c)),
        r as (select x, y from l union select r.x, l.y from r join l on r.y = l.x),
        m as (select x as doc_id, min(y) as y from r group by 1)
        select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) as component_id
        from d left join n using (doc_id) left join m using (doc_id)""",
    "op3_license_scan": rf"""
        with p as (select doc_id, coalesce(text, '') as text,
                     replace(replace(regexp_replace(coalesce(text, ''), '\n[^A-Za-z0-9\n]*\n|:[ \t\r]*\n', chr(1), 'g'), chr(10), ' '), chr(1), chr(10)) as whole from documents),
        s as (select doc_id, {_SENTENCES % "whole"} as w, {_SENTENCES % "text"} as l from p),
        i as (select doc_id, {_IDS % "w"} as w, {_IDS % "l"} as l from s),
        j as (select doc_id, list_concat(w, list_filter(l, lambda x: not list_contains(w, x))) as ids,
                     ',' || coalesce(array_to_string(w, ','), '') || ',' as j, ',' || coalesce(array_to_string(l, ','), '') || ',' as k from i),
        r as (select *, list_filter([{_RULE_SQL}], lambda x: x is not null) as a, list_filter([{_RULE_SQL}], lambda x: x not in {tuple(WEAK + [""])}) as b from j)
        select doc_id, cast(len(ids) as bigint) as n_sentences, coalesce(array_to_string(ids, ','), '') as sentence_ids,
               coalesce(array_to_string(list_sort(list_distinct(case when len(b) > 0 then b else a end)), ','), '') as licenses from r""",
    "op8_decontamination": rf"""
        with d as (select doc_id, {_W8} as w from documents),
        b as (select item_id, {_W8} as w from benchmark),
        bw as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
               from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)),
        ks as (select distinct k from bw),
        dw as (select doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') as g
               from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from d, ks where len(w) >= k)),
        hit as (select doc_id, i, dw.k, item_id from dw join bw using (k, g)),
        pos as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + k)) as p from hit) group by 1),
        its as (select doc_id, count(*) as n_items, sha256(string_agg(s, ',' order by s)) as h
                from (select distinct doc_id, cast(item_id as varchar) as s from hit) group by 1)
        select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               coalesce(h, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
        from d left join pos using (doc_id) left join its using (doc_id)""",
    "op10_substring_dedup": """
        with d as (select row_number() over (order by doc_id nulls last) as id, doc_id, hex(encode(coalesce(text, ''))) as x from documents),
        c as (select id, c, substr(x, 2000 * c + 1, 2198) as y from (select id, x, unnest(range(0, (strlen(x) + 1999) // 2000)) as c from d)),
        b as (select id, c, y, unnest(range(0, least(1000, strlen(y) // 2))) as j from c),
        w as (select id, 1000 * c + j as i, substr(y, 2 * j + 1, 2) as byte, case when strlen(y) >= 2 * j + 200 then substr(y, 2 * j + 1, 200) end as s from b),
        f as (select s, min(id * 1000000000 + i) as first from w where s is not null group by s),
        r as (select id, i, byte, case when id * 1000000000 + i > first then i end as again from w left join f using (s)),
        m as (select id, i, byte, coalesce(i - max(again) over (partition by id order by i rows unbounded preceding) < 100, false) as gone from r),
        e as (select *, gone and not coalesce(lag(gone) over (partition by id order by i), false) as opens from m),
        t as (select id, count(*) as n, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_spans,
                     string_agg(byte, '' order by i) filter (where not gone) as kept from e group by id)
        select doc_id, coalesce(n, 0) as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans,
               sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join t using (id)""",
    "op12_source_divergence": rf"""
        with d as (select row_number() over () as id, coalesce(lang, '') as lang, coalesce(source, '') as source, {_W12} as w from documents),
        t as (select lang, source, id, term, count(*) as n from (select lang, source, id, unnest(w) as term from d) group by all),
        kept as (select lang, term, sum(n)::hugeint as n from t group by all having count(*) >= 3),
        langs as (select lang, count(*) as v, sum(n)::hugeint as total from kept group by 1),
        c as (select t.lang, source, term, sum(t.n)::hugeint as n from t join kept using (lang, term) group by all),
        g as (select lang, source, coalesce(total, 0)::hugeint as total, coalesce(v, 0) as v from (select distinct lang, source from d)
              left join (select lang, source, sum(n) as total from c group by all) using (lang, source) left join (select lang, v from langs) using (lang)),
        p as (select lang, source, term, coalesce(c.n, 0) as n, 1 + {SCALE}::hugeint * (coalesce(c.n, 0) + 1) // (g.total + g.v) as p,
                     1 + {SCALE}::hugeint * (kept.n + 1) // (langs.total + langs.v) as q
              from g join kept using (lang) join langs using (lang) left join c using (lang, source, term)),
        pair as (select a.lang, a.source, 'pair' as part, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
                 from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
                 union all select a.lang, a.source, 'pair', b.source, 0 from g a join g b on a.lang = b.lang and a.source <> b.source where a.v = 0),
        term as (select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value from p where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank
                   from (select * from pair union all select * from term))
        select lang, source, part, item, value::bigint as value, rank::int as rank from ranked where part = 'pair' or rank <= {TERMS}""",
    "op13_spelling_variants": rf"""
        with recursive r as (select coalesce(doc_id::varchar, '') as d, {_AZ % "r"} as r
                             from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) as r from documents)),
        x as (select r, n, hex(encode(d || ':' || r)) as x from (select d, r, count(*) as n from r group by all)),
        h as (select r, n, {_CRC % ("x", "x")} as h from x),
        w as (select word, sum(n)::bigint as n from (select n, case when h % 199 = 0 then substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) else r end as word from h)
              where length(word) >= 6 group by 1 having sum(n) >= 5),
        c as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as cut from (select word, n, unnest(range(1, length(word) + 1)) as i from w)),
        near as (select distinct a.word, b.word as other, b.n from c a join c b on a.i = b.i and a.cut = b.cut and a.word <> b.word
                 union select c.word, w.word, w.n from c join w on c.cut = w.word
                 union select w.word, c.word, c.n from c join w on c.cut = w.word),
        best as (select word, count(*) as n_near, first(other order by n desc, other) as form, max(n) as form_n from near group by 1),
        v as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when form_n >= 5 * w.n then form end as form, case when form_n >= 5 * w.n then form_n end as form_n
              from w left join best using (word)),
        walk as (select word, word as root from v union all select walk.word, v.form from walk join v on v.word = walk.root where v.form is not null),
        last as (select walk.word, walk.root from walk join v on v.word = walk.root where v.form is null)
        select v.word, form, root, n, n_near, form_n from v join last using (word)""",
}
