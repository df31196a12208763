"""Divergence of sources by Gustavson row accumulation.

Every language keeps the terms that at least ``least`` of its documents hold. A group (language, source) gives each kept
term the smoothed share p = 1 + floor(scale * (count + 1) / (N + V)). The divergence of a group from another is the sum of
floor((p - q)^2 / q) over all kept terms, q the other's share; that of a term compares the group with its whole language.

Most terms do not occur in most groups and have the same share there, the baseline. So a pair's sum is taken as if no term
occurred in both: the terms of the one against the baseline of the other, which needs only how often each share occurs in
a group, and the baselines against each other. What this misses are terms in both groups. They are met by row: in every
block of terms, each group scatters its terms through the block's term-major index into a dense accumulator with a place
for each peer, which thus gathers the corrections. No pair of postings is ever a row.

All shares are computed as decimals and all divergences as 64-bit integers; partial sums are added as decimals.

Defined results: null text, language and source are read as empty; a group without terms has baseline shares; a language
without kept terms has pairs of divergence 0 and no terms; a language with one source has no pairs; repeated rows count
as documents each; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.scratch import staged

#: Scale of the shares, and how many terms of a group are reported.
SCALE, TERMS = 1_000_000_000, 200
#: Counts that a task gathers before it passes them on, and postings of a block of terms.
GATHERED, POSTINGS = 400_000, 400_000
#: A-Z in lower case, all other ASCII characters that are no letters as blanks.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_DOC = 1 << 40  # one document in a number that holds occurrences below it


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of a group, summed over a stretch of documents."""
    found: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text"), strict=True):
            counts = found.setdefault((lang, source), {})
            before = len(counts)
            for term, n in Counter(text.as_py().translate(_TERM).split()).items():
                counts[term] = counts.get(term, 0) + n + _DOC
            size += len(counts) - before
            if size >= GATHERED:
                yield from _flushed(found)
                found, size = {}, 0
    yield from _flushed(found)


def _flushed(found: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), counts in found.items():
        both = np.fromiter(counts.values(), np.int64, len(counts))
        k = len(counts)
        terms = pa.array(list(counts), pa.binary()).cast(pa.string())
        yield pa.record_batch([pa.array([lang] * k), pa.array([source] * k), terms, pa.array(both % _DOC), pa.array(both // _DOC)], schema=_COUNTS)


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact."""
    wide = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.call_function("div", wide, (total + terms).cast("decimal(20,0)")) + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // q


def _baselines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pairs as if no term occurred in both groups; every row is a group with its shares and its language's peers."""
    for rows in batches:
        for r in rows.itertuples():
            p, times = np.array(r.shares, np.int64), np.array(r.times, np.int64)
            base, size = np.array(r.bases, np.int64), np.array(r.sizes, np.int64)
            mine, theirs, own = np.zeros(len(base), np.int64), np.zeros(len(base), np.int64), np.int64(r.base)
            for at in range(0, len(p), 4096):  # few shares at a time, so that peers times shares stay small
                q, k = p[at : at + 4096, None], times[at : at + 4096, None]
                mine += (_f(q, base) * k).sum(0)
                theirs += (_f(base, q) * k).sum(0)
            mine += (r.kept - r.size - size) * _f(own, base)
            peer = np.arange(len(base))
            yield pd.DataFrame({"lang": r.lang, "g": r.at, "h": peer, "value": mine})[peer != r.at]
            yield pd.DataFrame({"lang": r.lang, "g": peer, "h": r.at, "value": theirs})[peer != r.at]


def _corrections(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """What terms in both groups change, for a block of terms: row by row through the term-major index."""
    _, _, peers = key
    term = pd.factorize(rows["term"])[0]
    order = np.argsort(term, kind="stable")
    term = term[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(term))])  # the index: postings of each term
    at, p, base = (rows[c].to_numpy(np.int64)[order] for c in ("at", "p", "base"))
    by_group = np.argsort(at, kind="stable")
    cuts = np.flatnonzero(np.diff(at[by_group], prepend=-1, append=-1))
    out = []
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        mine = by_group[lo:hi]
        fan = start[term[mine] + 1] - start[term[mine]]
        ends = np.cumsum(fan)
        met = np.arange(ends[-1]) + np.repeat(start[term[mine]] - ends + fan, fan)  # postings of the group's terms
        own, own_base = np.repeat(p[mine], fan), base[mine[0]]
        change = _f(own, p[met]) - _f(own, base[met]) - _f(own_base, p[met]) + _f(own_base, base[met])
        row = np.zeros(peers, np.int64)
        np.add.at(row, at[met], change)
        row[at[mine[0]]] = 0
        h = np.flatnonzero(row)
        out.append(pd.DataFrame({"lang": key[0], "g": at[mine[0]], "h": h, "value": row[h]}))
    return pd.concat(out) if out else pd.DataFrame({"lang": [], "g": [], "h": [], "value": []})


def audit(docs: DataFrame, least: int = 3, most: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: pairs of sources of a language, and the ``most`` terms a source has too often."""
    lang, source, text = (F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text"))
    counts = docs.select(lang, source, text.cast("binary").alias("text")).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    # dealt by the term alone, both groupings need no further exchange
    per = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    index = per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("of_lang"), F.collect_list(F.struct("source", "n")).alias("postings"))
    index = staged(index.filter(F.col("docs") >= least).drop("docs"), "divergence-index")

    postings = index.select("lang", "term", "of_lang", F.explode("postings").alias("x")).select("lang", "term", "of_lang", "x.source", "x.n")
    langs = index.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("of_lang").alias("lang_total"), F.sum(F.size("postings")).alias("n_postings"))
    totals = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("size"))
    groups = docs.select(lang, source).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "size", "kept", "lang_total", "n_postings"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1  # one row a source, as many as each has pairs
    base = F.when(F.col("kept") > 0, _share(F.lit(0), F.col("total"), F.col("kept"))).otherwise(1)
    groups = staged(groups.withColumns({"at": nth, "base": base, "peers": F.count("*").over(Window.partitionBy("lang"))}), "divergence-groups")

    rows = postings.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("kept")))
    rows = staged(rows.withColumn("q", _share(F.col("of_lang"), F.col("lang_total"), F.col("kept"))), "divergence-shares")
    shares = rows.groupBy("lang", "at", "p").agg(F.count("*").alias("k")).groupBy("lang", "at").agg(F.collect_list("p").alias("shares"), F.collect_list("k").alias("times"))
    peers = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "base", "size"))).alias("x"))
    peers = peers.select("lang", F.col("x.base").alias("bases"), F.col("x.size").alias("sizes"))
    none = F.array().cast("array<bigint>")
    own = groups.join(shares, ["lang", "at"], "left").join(peers, "lang")
    own = own.withColumns({"shares": F.coalesce("shares", none), "times": F.coalesce("times", none)})
    pair = "lang string, g long, h long, value long"
    apart = own.select("lang", "at", "kept", "size", "base", "shares", "times", "bases", "sizes").mapInPandas(_baselines, pair)
    block = F.pmod(F.xxhash64("term"), F.ceil(F.col("n_postings") / POSTINGS))
    both = rows.select("lang", block.alias("block"), "peers", "term", "at", "p", "base").groupBy("lang", "block", "peers").applyInPandas(_corrections, pair)
    sums = apart.unionByName(both).groupBy("lang", "g", "h").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value"))

    named = groups.select("lang", "at", "source")
    pairs = sums.join(named.withColumnRenamed("at", "g"), ["lang", "g"]).join(named.select("lang", F.col("at").alias("h"), F.col("source").alias("item")), ["lang", "h"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    d = F.col("p") - F.col("q")
    terms = rows.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div q").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", rank).unionByName(terms.withColumn("rank", rank).filter(F.col("rank") <= most))
