"""Benchmark decontamination: a broadcast hash set of normalised test n-grams against all training windows.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. A window is ``n`` consecutive
words of an item; an item with fewer words, but not none, is one window. Every document window whose hash is in the
set is compared word by word with the item's window; only equal ones count.

The windows' hashes are kept in the plan as a set up to ``max_set`` of them. A larger benchmark is joined by hash
instead, by whatever join Spark chooses from the measured size: slower, the same result.

Hits belong to a row's identifier and text (by SHA-256), never to an identifier alone: rows without an identifier, or with
that of another text, are told apart.

Defined results: null and empty texts have no words; repeated documents or items are each treated alike; with an
empty benchmark nothing is hit; a null item_id counts under the empty name; further columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.scratch import staged

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _exact(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _folded(text: Column) -> Column:
    """Full lower case, quicker than A-Z alone. Texts equal under ``_exact`` are equal here, with the same word bounds."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def _words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), _SPLIT), lambda w: w != "")


def _window_hash(words: Column, start: Column, length: Column) -> Column:
    return F.xxhash64(F.slice(words, start + 1, length))


def text_key(text: Column) -> Column:
    """With the doc_id it tells a row from all but its repetitions."""
    return F.unhex(F.sha2(text, 256))


def _starts(words: Column, length: int) -> Column:
    """0-based starts of the windows of ``length`` words."""
    n = F.size(words) - length
    return F.when(n >= 0, F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def benchmark_windows(benchmark: DataFrame, n: int) -> DataFrame:
    """``item, length, hash, gram``: every window of every item, ``gram`` its words, ``hash`` that of its folded form."""
    b = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    b = b.withColumns({"w": _words(_exact(F.col("text"))), "f": _words(_folded(F.col("text")))}).filter("size(w) > 0")
    b = b.withColumn("length", F.least(F.size("w"), F.lit(n)))
    b = b.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("length"))))
    gram = F.array_join(F.slice("w", F.col("start") + 1, F.col("length")), " ")
    return b.select("item", "length", _window_hash(F.col("f"), F.col("start"), F.col("length")).alias("hash"), gram.alias("gram")).distinct()


def contamination_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_set: int = 200_000) -> DataFrame:
    """``doc_id, key, n_words, hits`` per document; ``hits`` are the equal windows as (start, length, item), ``key`` its ``text_key`` if there are any."""
    windows = staged(benchmark_windows(benchmark, n), "benchmark-windows")
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # 1 to n
    hashes = windows.select("hash").distinct().limit(max_set + 1).collect()
    if len(hashes) > max_set:
        return _hits_by_join(docs, windows, lengths)
    known = [r[0] for r in hashes]

    def of_length(words: Column, k: int) -> Column:
        starts = F.filter(_starts(words, k), lambda s: _window_hash(words, s, F.lit(k)).isin(known))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(k).alias("length")))

    def maybe(words: Column) -> Column:
        none = F.array().cast("array<struct<start:int,length:int>>")
        return F.struct(F.size(words).alias("n_words"), F.concat(none, *(of_length(words, k) for k in lengths)).alias("at"))

    scan = docs.select("doc_id", "text", _let(_words(_folded(F.col("text"))), maybe).alias("m"))
    grams = _let(_words(_exact(F.col("text"))), lambda w: F.transform("m.at", lambda m: _with_gram(w, m)))
    found = F.size("m.at") > 0
    scan = scan.select("doc_id", F.when(found, text_key(F.col("text"))).alias("key"), "m.n_words", F.when(found, grams).alias("grams"))
    scan = staged(scan, "window-hits")
    return _per_document(scan, scan.select("doc_id", "key", F.explode("grams").alias("g")).select("doc_id", "key", "g.*"), windows)


def _hits_by_join(docs: DataFrame, windows: DataFrame, lengths: list[int]) -> DataFrame:
    """The same through joins on the windows' hashes, for sets too large to send to every task."""

    def of_length(words: Column, k: int) -> Column:
        return F.transform(
            _starts(words, k),
            lambda s: F.struct(s.alias("start"), F.lit(k).alias("length"), _window_hash(words, s, F.lit(k)).alias("hash")),
        )

    def every(words: Column) -> Column:
        return F.struct(F.size(words).alias("n_words"), F.concat(*(of_length(words, k) for k in lengths)).alias("at"))

    docs = docs.select("doc_id", text_key(F.col("text")).alias("key"), "text")
    scan = docs.select("doc_id", "key", _let(_words(_folded(F.col("text"))), every).alias("m"))
    some = scan.select("doc_id", "key", F.explode("m.at").alias("at")).select("doc_id", "key", "at.*")
    some = some.join(windows.select("length", "hash").distinct(), ["length", "hash"], "left_semi")
    some = some.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "length")).alias("at"))
    texts = docs.join(some, _same_row())
    grams = _let(_words(_exact(F.col("text"))), lambda w: F.transform("at", lambda m: _with_gram(w, m)))
    some = texts.select("doc_id", "key", F.explode(grams).alias("g")).select("doc_id", "key", "g.*")
    return _per_document(scan.select("doc_id", "key", "m.n_words"), some, windows)


def _same_row() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_gram(words: Column, m: Column) -> Column:
    return F.struct(m["start"].alias("start"), m["length"].alias("length"), F.array_join(F.slice(words, m["start"] + 1, m["length"]), " ").alias("gram"))


def _per_document(counts: DataFrame, grams: DataFrame, windows: DataFrame) -> DataFrame:
    hits = grams.join(windows.select("length", "gram", "item").distinct(), ["length", "gram"])
    per = hits.groupBy(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.collect_set(F.struct("start", "length", "item")).alias("hits"))
    none = F.array().cast("array<struct<start:int,length:int,item:string>>")
    joined = counts.join(per, _same_row(), "left")
    return joined.select("doc_id", "key", F.col("n_words").cast("long").alias("n_words"), F.coalesce("hits", none).alias("hits"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_set: int = 200_000) -> DataFrame:
    """``doc_id, n_words, n_hit, items, contaminated`` per document; ``items`` sorted as strings."""
    hits = contamination_hits(docs, benchmark, n, max_set)
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    items = F.sort_array(F.array_distinct(F.transform("hits", lambda h: h["item"])))
    out = hits.select("doc_id", "n_words", F.size(covered).cast("long").alias("n_hit"), items.alias("items"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = 10, max_set: int = 200_000) -> DataFrame:
    """The documents with no window of the benchmark, all columns kept."""
    hit = contamination_hits(docs, benchmark, n, max_set).filter("size(hits) > 0").select(F.col("doc_id").alias("_hit"), F.col("key").alias("_key")).distinct()
    hit = staged(hit, "hit-ids")  # its size is known then: Spark broadcasts it if it is small, else it shuffles both
    own = F.col("own_rows.doc_id").eqNullSafe(F.col("hit_rows._hit")) & (text_key(F.col("own_rows.text")) == F.col("hit_rows._key"))
    return docs.alias("own_rows").join(hit.alias("hit_rows"), own, "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """All documents; those with hits are rebuilt from their words that are not hit, joined by single spaces."""
    hits = contamination_hits(docs, benchmark, n).filter("size(hits) > 0").dropDuplicates(["doc_id", "key"])
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["length"] - 1))))
    marks = hits.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), covered.alias("_gone"))
    text, gone = F.col("own_rows.text"), F.col("marks._gone")
    left = _let(_words(text), lambda w: F.transform(F.array_except(F.sequence(F.lit(0), F.size(w) - 1), gone), lambda i: F.get(w, i)))  # by hashing, not a search for each word
    own = F.col("own_rows.doc_id").eqNullSafe(F.col("marks._id")) & (text_key(text) == F.col("marks._key"))
    new = F.when(gone.isNull(), text).otherwise(F.array_join(left, " ")).alias("text")
    return docs.alias("own_rows").join(marks.alias("marks"), own, "left").select(*(new if c == "text" else F.col(f"own_rows.`{c}`") for c in docs.columns))
