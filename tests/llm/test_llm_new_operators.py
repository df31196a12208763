"""Source mixing, source divergence and spelling variants against brute-force versions, with every awkward case."""

import collections
import math
import os
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import divergence, source_mixing, spelling
from shelfmark.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORDS = "the of river rivers stone stones Garden garden gardens window Fenêtre fenêtres paper papers silver sliver answer answers machine thunder".split()


@pytest.fixture(scope="module")
def rows():
    """(doc_id, text, lang, source); a null and a shared identifier, repeated rows, empty, null and long texts, odd characters."""
    r = random.Random(3)
    out = [(i, " ".join(r.choice(WORDS) for _ in range(r.choice([1, 5, 40, 200]))), r.choice(["en", "fr"]), r.choice(["a", "b", "a", "c é"])) for i in range(120)]
    out += [(200, None, "en", "a"), (201, "", "en", "b"), (202, " \t\x0b", "fr", None), (203, "only here", None, None), (203, "only here too", None, "b")]
    out += [(None, "river stones river", "en", "a"), (None, "river stones river", "en", "a"), (5, "stone", "en", "c é"), (5, "stone", "en", "c é")]
    out += [(204, "river " * 30000 + "\x00x1y2_z ÀÉ×÷ 東京 gardens\U0001f600", "en", "b"), (205, "", "xx", "lonely")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    clash = [(*row, 1, "x", 2.0, "y", 3) for row in rows]
    return spark.createDataFrame(clash, "doc_id long, text string, lang string, source string, size int, term string, p double, word string, at int").repartition(5)


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes, weights=(5, 2, 1), most=3):
    """By repeated sharing: who is above the bound is fixed there, the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = sum(sizes.values()) - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = [s for s in free if share[s] >= most * sizes[s]]
        if not above:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in above}


@pytest.mark.parametrize("block", [source_mixing.BLOCK, 20])
def test_mixing(docs, rows, block):
    got = source_mixing.mix(docs, block=block).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in got) == sorted((i is None, i or 0, words(t)) for i, t, _, _ in rows)
    sizes = collections.Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    want, taken = targets(sizes), collections.Counter()
    assert sum(want.values()) == pytest.approx(sum(sizes.values()))
    for r in got:
        rate = want[r.source] / sizes[r.source] if sizes[r.source] else 0
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert not r.size or r.copies in (math.floor(rate + 1e-9), math.ceil(rate - 1e-9))
        taken[r.source] += r.taken
    for s in "a", "c é":  # the others hold one very long text or a few words
        assert abs(taken[s] - want[s]) <= max(5, 0.01 * want[s])
    again = source_mixing.mix(docs.repartition(2), block=block)
    assert sorted(map(str, again.collect())) == sorted(map(str, got))


def test_mixing_keeps_both_totals():
    """The flight changes neither the documents nor the tokens, and settles all but a few."""
    r = random.Random(1)
    sizes, chances = [r.choice([3, 3, 50, 700]) for _ in range(500)], [0.3] * 500
    p = source_mixing.flight(sizes, chances, r, 8)
    assert sum(0 < c < 1 for c in p) <= 8 and all(0 <= c <= 1 for c in p)
    assert sum(p) == pytest.approx(150) and sum(c * s for c, s in zip(p, sizes)) == pytest.approx(0.3 * sum(sizes))
    fates = source_mixing.make_up(sizes, [round(c) for c in p], 400.0)
    assert abs(400 + sum((b - round(c)) * s for b, c, s in zip(fates, p, sizes))) < 3


def test_mixing_draws_by_chance():
    """Over many seeds every document is taken about as often as its probability says."""
    sizes, seen = [5, 9, 9, 14, 30, 31, 70, 71, 72, 200], [0.0] * 10
    for seed in range(3000):
        for i, c in enumerate(source_mixing.flight(sizes, [0.4] * 10, random.Random(seed), 2)):
            seen[i] += c / 3000
    assert all(abs(c - 0.4) < 0.04 for c in seen)


@pytest.mark.parametrize("of", [{"a": 10, "b": 10, None: 1000}, {"a": 0, "b": 7}, {"a": 1, "b": 1, "c": 1, "d": 500, "e": 2}])
def test_targets(spark, of):
    sources = [(s, i, n, 1) for i, (s, n) in enumerate(of.items())]
    got = source_mixing.with_targets(spark.createDataFrame(sources, "source string, at long, source_size long, documents long")).collect()
    want = targets(of)
    assert {r.source: r.target for r in got} == pytest.approx({s: want[s] for s in of})


def divergences(rows, least, most):
    docs = [(la or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")) for _, t, la, s in rows]
    docs = [(la, s, [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]) for la, s, ws in docs]
    out = []
    for lang in {d[0] for d in docs}:
        held = collections.Counter(w for d in docs if d[0] == lang for w in set(d[2]))
        kept = [w for w, n in held.items() if n >= least]
        counts = {s: collections.Counter(w for d in docs if d[:2] == (lang, s) for w in d[2]) for s in {d[1] for d in docs if d[0] == lang}}
        counts[None] = sum(counts.values(), collections.Counter())
        total = {s: sum(c[w] for w in kept) for s, c in counts.items()}
        p = {s: {w: 1 + divergence.SCALE * (c[w] + 1) // (total[s] + len(kept)) for w in kept} for s, c in counts.items()}
        for s in counts:
            if s is None:
                continue
            pairs = [(sum((p[s][w] - p[o][w]) ** 2 // p[o][w] for w in kept), o) for o in counts if o not in (s, None)]
            terms = [((p[s][w] - p[None][w]) ** 2 // p[None][w], w) for w in kept if counts[s][w] and p[s][w] > p[None][w]]
            for part, found in (("pair", pairs), ("term", terms)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= most:
                        out.append((lang, s, part, item, v, rank))
    return sorted(out)


@pytest.mark.parametrize("postings, gathered, most", [(400_000, 400_000, 200), (5, 7, 4)])
def test_divergence(docs, rows, monkeypatch, postings, gathered, most):
    monkeypatch.setattr(divergence, "POSTINGS", postings)
    monkeypatch.setattr(divergence, "GATHERED", gathered)
    got = divergence.audit(docs, 3, most).collect()
    assert sorted(map(tuple, got)) == divergences(rows, 3, most)
    assert any(r.lang == "" and r.value == 0 for r in got)  # a language without kept terms


def edits(word):
    letters = {c for w in WORDS for c in w.lower()} | set("éàê")
    for i in range(len(word) + 1):
        yield from (word[:i] + c + word[i:] for c in letters)
        yield from (word[:i] + c + word[i + 1 :] for c in letters if i < len(word))
        yield word[:i] + word[i + 1 :]


def spellings(rows, least, shortest, times):
    n = collections.Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    near = {w: sorted(((-n[o], o) for o in set(edits(w)) & set(n) - {w})) for w in n}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= times * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("most, shortest", [(spelling.LIST, 6), (2, 6), (3, 3)])
def test_spelling(docs, rows, monkeypatch, most, shortest):
    monkeypatch.setattr(spelling, "GATHERED", 3)
    got = spelling.variants(docs, least=2, shortest=shortest, times=2, most=most).collect()
    assert sorted(map(tuple, got), key=str) == sorted(spellings(rows, 2, shortest, 2), key=str)
    assert any(r.form for r in got) and any(r.n_near > 1 for r in got)


@pytest.mark.parametrize("most", [4, 1000])
def test_near_words_over_a_small_alphabet(spark, most):
    """Many words in few lists, which are divided again and again; each pair is met once."""
    r = random.Random(7)
    vocabulary = {"".join(r.choice("ab") for _ in range(r.randint(6, 9))): r.randint(1, 9) for _ in range(300)}
    got = spelling.near_words(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), 6, most).collect()

    def near(a, b):
        cuts = [{w[:i] + w[i + 1 :] for i in range(len(w))} for w in (a, b)]
        return a in cuts[1] or b in cuts[0] or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1)

    want = {a: [(-vocabulary[b], b) for b in vocabulary if near(a, b)] for a in vocabulary}
    assert {x.word: (x.n_near, tuple(x.best)) for x in got} == {a: (len(x), min(x)) for a, x in want.items() if x}


def test_roots_of_long_chains(spark):
    links = [(f"w{i}", f"w{i + 1}") for i in range(21)] + [("x", "w3")]
    got = {r.word: r.root for r in spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()}
    assert set(got.values()) == {"w21"} and len(got) == 22


def test_empty_tables(docs):
    empty = docs.limit(0)
    assert source_mixing.mix(empty).count() == divergence.audit(empty).count() == spelling.variants(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")
@pytest.mark.parametrize("name", ["op10_substring_dedup", "op12_source_divergence", "op13_spelling_variants"])
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)
