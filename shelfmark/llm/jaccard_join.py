"""Jaccard self-join on word shingles with adaptive multi-match prefixes (after Wang, Li and Feng, SIGMOD 2012).

A document's set holds its distinct shingles of ``words`` consecutive words (A-Z lower-cased, split at
``[\\x20\\x09-\\x0D]``); with fewer words the whole sequence is the one shingle. Shingles are 64-bit hashes. Two sets of
sizes a and b that link share at least ``alpha = ceil(num * (a + b) / (num + den))`` shingles, so in any common order the
first ``a - alpha + l`` of one and the first ``b - alpha + l`` of the other share at least ``l``.

1. Every set's prefix in hash order, for as many matches as a sixteenth of its size, goes to its shingles' lists. A set
   with fewer of its prefix shingles in lists of several sets than the matches it needs links with nothing. The rest,
   the survivors, are fetched whole. A task sends a shingle once or twice, however many of its sets hold it.
2. Each survivor is verified against one other set, the head it shares most of its 64 least shingles with; a list's head
   is its set whose shingles are the most common. What links is merged into components: near copies of one original.
3. Shingles whose lists lie within one component cannot link components, so they come first in each survivor's order, all
   others follow by the length of their lists. Each set estimates the cost of its candidates from the entries of its
   lists for 1, 2, 4, 8 and 16 matches and lengthens its prefix to the cheapest. It reads the first
   ``a - alpha + 1`` lists; pairs of different components met there must share that many shingles within their prefixes.
   They also must not differ too much in ``BITS`` parities of their shingles: each shingle that is in only one of two sets
   changes one of them, so sets of which ``d`` parities differ share at most ``(a + b - d) / 2`` (the bitmap filter of
   Sandes, Teodoro and Melo, 2017). So near copies of one original that do not link are told apart where they meet.
4. All pairs are verified on the whole sets. Components of all verified links are the result.

A large group of near copies is thus one component after step 2 and its pairs are never listed; no link between
different components is missed, as step 3 holds for every such pair.

Defined results: null texts and texts without words have an empty set and link with nothing, component_id is their own
doc_id; repeated rows and rows that share a doc_id are told apart by their texts; a null doc_id comes after all others, so
component_id is null only where no row of a component has one; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm.rolling import mix, word_hashes
from shelfmark.operators.components import connected_components
from shelfmark.scratch import staged

MATCHES = (1, 2, 4, 8, 16)
#: Shingles of each survivor by which its head is chosen.
SKETCH = 64
#: What verifying one candidate costs, in list entries read.
VERIFY = 8
#: Parities kept of a set, while this number can tell sets of its size apart.
BITS = 256
#: Postings a task gathers before it combines and sends them.
_HELD = 2_000_000
_WORDS = [f"w{i}" for i in range(BITS // 64)]
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for h, counts in word_hashes(texts):
        n = max(0, len(h) - words + 1)
        out = np.zeros(n, np.uint64)
        for k in range(words):
            out = (out ^ h[k : k + n]) * _MULT[k % len(_MULT)]
            out ^= out >> np.uint64(29)
        ends = np.cumsum(counts)
        for first, last in zip((ends - counts).tolist(), ends.tolist(), strict=True):
            if last - first >= words:
                own = np.sort(out[first : last - words + 1])
                yield own[np.concatenate(([True], own[1:] != own[:-1]))]
            elif last > first:
                short = np.uint64(last - first)
                for k in range(first, last):
                    short = mix((short ^ h[k : k + 1]) * _MULT[k - first])[0]
                yield np.array([short])
            else:
                yield np.zeros(0, np.uint64)


def _matches(n: Column) -> Column:
    """How many matches the first prefix of a set of ``n`` is good for."""
    return F.greatest(F.lit(1), F.floor(n / 16)).cast("long")


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


_ROW = pa.struct([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64()), ("digest", pa.binary()), ("text_key", pa.binary())])


def _pieces(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batch some rows at a time; what Arrow freed meanwhile goes back, else each worker keeps the most it ever took."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
    pa.default_memory_pool().release_unused()


def postings(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Three kinds of rows, ``token, key, k, row``; ``key`` is the head of the digest of a set.

    With a ``row``: a document, its set's size and digest. With a ``token``: it is in the prefix of this set, which counts
    for ``k`` if other sets have it too. With neither: ``k`` prefix shingles of this set are in others of the same task.
    """

    def batch(token=None, key=None, k=None, row=None) -> pa.RecordBatch:
        n = len(next(x for x in (key, row) if x is not None))
        fill = lambda x, kind: pa.nulls(n, kind) if x is None else pa.array(x, kind)
        return pa.RecordBatch.from_arrays([fill(token, pa.int64()), fill(key, pa.int64()), fill(k, pa.int64()), fill(row, _ROW)], ["token", "key", "k", "row"])

    def combined(tokens: list[np.ndarray], keys: list[int]) -> Iterator[pa.RecordBatch]:
        token, key = np.concatenate(tokens), np.repeat(np.array(keys, np.int64), list(map(len, tokens)))
        order = np.lexsort((key, token))
        token, key = token[order], key[order]
        new_token = np.concatenate(([True], token[1:] != token[:-1]))
        new = new_token | np.concatenate(([True], key[1:] != key[:-1]))  # equal sets count once
        token, key, new_token = token[new], key[new], new_token[new]
        first = np.flatnonzero(new_token)
        size = np.diff(np.append(first, len(token)))
        alone, low = first[size == 1], first[size > 1]
        high = low + size[size > 1] - 1
        at = np.concatenate((alone, low, high))
        yield batch(token[at].astype(np.int64), key[at], np.repeat([1, 0], [len(alone), 2 * len(low)]))
        own, k = np.unique(key[np.repeat(size > 1, size)], return_counts=True)
        if len(own):
            yield batch(None, own, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, keys, held = [], [], 0
        for b in (part for whole in batches for part in _pieces(whole)):
            texts = b.column("text").to_pylist()
            rows = []
            for doc, text, own in zip(b.column("doc_id").to_pylist(), texts, shingle_sets(texts, words), strict=True):
                n = len(own)
                digest = xxhash.xxh128_digest(own.tobytes())
                key = int.from_bytes(digest[:8], "little", signed=True)
                rows.append({"doc_id": doc, "n": n, "key": key, "digest": digest, "text_key": hashlib.sha256((text or "").encode("utf-8", "replace")).digest()})
                if n:
                    prefix = own[: min(n, n - -(-num * n // den) + max(1, n // 16))]
                    tokens.append(prefix.copy())
                    keys.append(key)
                    held += len(prefix)
            if rows:
                yield batch(row=rows)
            if held > _HELD:
                yield from combined(tokens, keys)
                tokens, keys, held = [], [], 0
        if tokens:
            yield from combined(tokens, keys)

    schema = "token long, key long, k long, row struct<doc_id: bigint, n: bigint, key: bigint, digest: binary, text_key: binary>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def survivors(posted: DataFrame, num: int, den: int) -> DataFrame:
    """``digest``: the sets with so many shared prefix shingles that they can link."""
    same = Window.partitionBy("token")  # no longer than two rows for each chunk of a task
    shared = posted.filter("token is not null").select("token", "key", "k", (F.min("key").over(same) != F.max("key").over(same)).alias("many"))
    counts = shared.filter("many and k > 0").select("key", "k").unionByName(posted.filter("token is null and row is null").select("key", "k"))
    counts = counts.groupBy("key").agg(F.sum("k").alias("k"))
    sets = posted.filter("row is not null and row.n > 0").select("row.key", "row.digest", "row.n").distinct()
    least = _matches(F.ceil(F.lit(num) * F.col("n") / F.lit(float(den)) - F.lit(1e-9)))
    return sets.join(counts, "key").filter(F.col("k") >= least).select("digest")


def parities(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """For sets of these sizes, whose tokens follow each other, ``BITS`` parities each as 64-bit numbers: how many tokens fall on a bit."""
    at = np.repeat(np.arange(len(sizes)) * BITS, sizes) + (tokens & np.uint64(BITS - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(sizes) * BITS).astype(np.uint8) & 1
    return np.packbits(odd).view(np.int64).reshape(len(sizes), BITS // 64)


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """``digest, n, tokens, bits``: the whole sets of the documents' texts, and their parities."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in _pieces(whole)):
            own = list(shingle_sets(b.column("text").to_pylist(), words))
            sizes = np.array(list(map(len, own)), np.int64)
            flat = np.concatenate(own)
            tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat.astype(np.int64)))
            digests = pa.array([xxhash.xxh128_digest(s.tobytes()) for s in own], pa.binary())
            bits = pa.StructArray.from_arrays([pa.array(c) for c in parities(sizes, flat).T], _WORDS)
            yield pa.RecordBatch.from_arrays([digests, pa.array(sizes), tokens, bits], ["digest", "n", "tokens", "bits"])

    bits = ", ".join(f"{c}: bigint" for c in _WORDS)
    return docs.select("text").mapInArrow(run, f"digest binary, n long, tokens array<long>, bits struct<{bits}>")


def _alpha(a: Column, b: Column, num: int, den: int) -> Column:
    return F.ceil((F.lit(num) * (a + b)) / F.lit(float(num + den)) - F.lit(1e-9))


def _may_link(p: Column, q: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether sets of ``a`` and ``b`` tokens and these parities, null for sets too large for them, may share enough to link."""
    differ = sum((F.bit_count(p[c].bitwiseXOR(q[c])) for c in _WORDS[1:]), F.bit_count(p[_WORDS[0]].bitwiseXOR(q[_WORDS[0]])))
    return F.coalesce(differ <= a + b - 2 * _alpha(a, b, num, den), F.lit(True))


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs ``src, dst`` whose whole sets link."""
    a = sets.select(F.col("node").alias("src"), F.col("tokens").alias("a"))
    b = sets.select(F.col("node").alias("dst"), F.col("tokens").alias("b"))
    common = F.size(F.array_intersect("a", "b"))
    return pairs.join(a, "src").join(b, "dst").filter(den * common >= num * (F.size("a") + F.size("b") - common)).select("src", "dst")


def _near_heads(sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of each set with the head of most of its lists, if there is any of a fitting size: one pair for each set at most."""
    few = sets.select("node", "n", F.explode(F.slice("tokens", 1, SKETCH)).alias("token"))
    lengths = few.groupBy("token").agg(F.count("*").alias("df")).filter("df > 1")
    few = staged(few.join(lengths, "token"), "sketches")
    common = few.groupBy("node").agg(F.sum("df").alias("weight"))
    few = staged(few.drop("df").join(common, "node"), "weighed-sketches")
    heads = few.groupBy("token").agg(F.max(F.struct("weight", (-F.col("node")).alias("order"), "n")).alias("h"))
    met = few.join(heads, "token").select("node", "n", (-F.col("h.order")).alias("head"), F.col("h.n").alias("m"))
    met = met.filter(F.col("head") != F.col("node")).filter(F.least("n", "m") * den >= F.greatest("n", "m") * num)
    best = met.groupBy("node", "head").agg(F.count("*").alias("k")).groupBy("node").agg(F.max(F.struct("k", "head")).alias("b"))
    return best.select(F.col("b.head").alias("src"), F.col("node").alias("dst"))


def _chosen(own: DataFrame, num: int, den: int) -> DataFrame:
    """``node, l``: for each set the number of matches that makes its candidates cheapest.

    The list entries that a set would read for ``l`` matches are counted as they are for sets of its own size: entries of
    lists it reads, of other components than its own, at places that such a set's prefix for ``l`` matches reaches. Each
    must be read, and every ``l`` of them may be one candidate to verify.
    """
    short = F.col("n") - _alpha(F.col("n"), F.col("n"), num, den)
    rows = own.select("node", "n", "c", short.alias("short"), "closed", F.posexplode("own").alias("i", "token"))
    rows = rows.select("node", "n", "c", "token", (F.col("i") + F.col("closed") - F.col("short")).alias("beyond"))
    own_lists = rows.groupBy("token", "c").agg(*(F.count_if(F.col("beyond") < k).alias(f"o{k}") for k in MATCHES))
    lists = own_lists.groupBy("token").agg(*(F.sum(f"o{k}").alias(f"d{k}") for k in MATCHES))
    read = rows.filter("beyond < 1").join(own_lists, ["token", "c"]).join(lists, "token")
    read = read.groupBy("node").agg(F.max("n").alias("n"), *(F.sum(F.col(f"d{k}") - F.col(f"o{k}")).alias(f"d{k}") for k in MATCHES))
    costs = [F.struct((F.col(f"d{k}") * (1 + VERIFY / k)).alias("cost"), F.lit(k).alias("l")) for k in MATCHES]
    fits = [F.when((F.lit(k) == 1) | (F.col("n") * num >= k * den), c) for k, c in zip(MATCHES, costs, strict=True)]  # smaller sets cannot share k
    read = read.select("node", F.array_min(F.array_compact(F.array(*fits)))["l"].alias("l"))
    return own.select("node").join(read, "node", "left").select("node", F.coalesce("l", F.lit(1)).alias("l"))


def _across(sets: DataFrame, component: DataFrame, num: int, den: int) -> DataFrame:
    """Candidate pairs of different components by adaptive prefixes, each set reading for those not above it in size."""
    bits = sets.filter(2 * (F.col("n") - _alpha(F.col("n"), F.col("n"), num, den)) <= BITS // 2).select("node", "bits")  # of random parities half differ
    sets = sets.join(component.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    sets = sets.select("node", "n", F.coalesce("component", "node").alias("c"), "tokens")
    rows = sets.select("node", "n", "c", F.explode("tokens").alias("token"))
    lists = rows.groupBy("token").agg(F.count("*").alias("df"), F.min("c").alias("low"), F.max("c").alias("high"))
    rows = rows.join(lists.filter("low != high").select("token", "df"), "token")
    own = rows.groupBy("node", "n", "c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own"))  # no longer than the set
    base = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(float(den)) - F.lit(1e-9))
    own = own.withColumns({"base": base.cast("int"), "closed": (F.col("n") - F.size("own")).cast("int")})

    def first(k) -> Column:
        """The open ones among the first ``base + k`` shingles."""
        return F.slice("own", 1, F.greatest(F.col("base") + k - F.col("closed"), F.lit(0)))

    own = own.withColumn("own", first(MATCHES[-1])).filter(F.size("own") > 0)
    own = staged(own.select("node", "n", "c", "closed", "base", F.transform("own", lambda e: e["token"]).alias("own")), "prefixes")
    own = own.join(_chosen(own, num, den), "node")

    with_bits = own.join(bits, "node", "left")
    probe = with_bits.select(F.col("node").alias("x"), F.col("n").alias("a"), F.col("c").alias("cx"), "l", "closed", F.col("bits").alias("p"), F.posexplode(F.slice("own", 1, F.greatest(F.col("base") + 1 - F.col("closed"), F.lit(0)))).alias("i", "t"))
    probe = probe.withColumn("i", F.col("i") + F.col("closed")).drop("closed")
    index = with_bits.select(F.col("node").alias("y"), F.col("n").alias("b"), F.col("c").alias("cy"), "closed", F.col("bits").alias("q"), F.posexplode("own").alias("j", "token"))
    index = index.withColumn("j", F.col("j") + F.col("closed")).drop("closed")
    alpha = _alpha(F.col("a"), F.col("b"), num, den)
    meet = (
        (F.col("cx") != F.col("cy"))
        & ((F.col("b") < F.col("a")) | ((F.col("b") == F.col("a")) & (F.col("y") < F.col("x"))))
        & (F.col("b") * den >= F.col("a") * num)
        & (F.col("i") < F.col("a") - alpha + 1)
        & (F.col("j") < F.col("b") - alpha + F.col("l"))
        & _may_link(F.col("p"), F.col("q"), F.col("a"), F.col("b"), num, den)
    )
    met = probe.join(index, (F.col("t") == F.col("token")) & meet).select("x", "y", "a", "b", "l").distinct()
    within = lambda own, n, closed: F.slice(own, 1, F.greatest((F.col(n) - alpha + F.col("l")).cast("int") - F.col(closed), F.lit(0)))
    met = met.join(own.select(F.col("node").alias("x"), F.col("own").alias("ox"), F.col("closed").alias("kx")), "x")
    met = met.join(own.select(F.col("node").alias("y"), F.col("own").alias("oy"), F.col("closed").alias("ky")), "y")
    enough = F.size(F.array_intersect(within("ox", "a", "kx"), within("oy", "b", "ky"))) >= F.col("l")
    return met.filter(enough).select(F.col("x").alias("src"), F.col("y").alias("dst"))


def classified(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """``doc_id, n, text_key, first`` per document; ``first`` is the first (absent, doc_id, text_key) of its component."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    posted = staged(postings(docs, words, num, den), "postings")
    rows = posted.filter("row is not null").select("row.*")
    alive = staged(survivors(posted, num, den), "survivors")
    order = F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "text_key")
    firsts = rows.groupBy("digest").agg(F.min(order).alias("first"))
    reps = firsts.join(alive, "digest").select("first.doc_id", "first.text_key")
    reps = staged(reps, "representatives")
    texts = docs.withColumn("text_key", text_key(F.col("text"))).alias("d").join(reps.alias("r"), F.expr("d.doc_id <=> r.doc_id and d.text_key = r.text_key"), "left_semi")
    sets = staged(sets_of(texts, words).withColumn("node", F.monotonically_increasing_id()), "sets")

    links = staged(_verified(staged(_near_heads(sets, num, den), "first-pairs"), sets, num, den), "links")
    component = staged(connected_components(links), "first-components")
    pairs = staged(_across(sets, component, num, den), "more-pairs")
    links = links.unionByName(staged(_verified(pairs, sets, num, den), "more-links"))
    component = connected_components(links)

    linked = sets.select("node", "digest").join(component, "node").select("digest", "component").distinct()
    of_class = linked.join(firsts, "digest")
    least = of_class.groupBy("component").agg(F.min("first").alias("first"))
    of_class = of_class.drop("first").join(least, "component").select("digest", F.col("first").alias("linked"))
    out = rows.join(firsts.join(of_class, "digest", "left"), "digest")
    own = F.when(F.col("n") == 0, order).otherwise(F.coalesce("linked", "first"))
    return out.select("doc_id", "n", "text_key", own.alias("first"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``doc_id, n_shingles, component_id`` per document; sets link when ``den * |intersection| >= num * |union|``."""
    out = classified(docs, words, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents with one, the smallest doc_id, of each component; all columns kept. Repeated rows share their fate."""
    same = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_key") == F.col("text_key"))
    gone = classified(docs, words, num, den).filter(~same).select(F.col("doc_id").alias("_gone"), F.col("text_key").alias("_key")).distinct()
    gone = staged(gone, "gone")  # its size is known then: Spark broadcasts it if it is small
    own = F.col("own_rows.doc_id").cast("long").eqNullSafe(F.col("gone_rows._gone")) & (text_key(F.col("own_rows.text")) == F.col("gone_rows._key"))
    return docs.alias("own_rows").join(gone.alias("gone_rows"), own, "left_anti")
