"""The pipeline against a brute-force version of its stages."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import decontaminate, queries

WORDS = "the of and to in river stone cloud garden window paper silver answer every little machine thunder quiet yellow harbour".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    make = lambda n: " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))
    docs, labels = [], []
    for i in range(150):
        w = make(60).split()
        if i % 3 == 0:
            for _ in range(4):
                w[r.randrange(60)] = r.choice(["vile", "rotten"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 3 == 0)))
    docs += [(200, docs[1][1].replace(" ", "\n")), (201, docs[2][1]), (202, docs[4][1].rsplit(" ", 1)[0] + " other"), (203, None), (204, ""), (205, None)]
    passage = make(12)
    docs += [(210, make(20) + " " + passage.upper() + " " + make(20)), (211, make(20) + " " + " ".join(passage.split()[:9]) + " " + make(20))]
    out = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return out, passage


@pytest.fixture(scope="module")
def network(spark, folder):
    """Fitted once for the tests that look at other things."""
    return queries.toxicity_network(*(spark.read.parquet(f"{folder[0]}/{t}.parquet") for t in ("documents", "labels")))


@pytest.fixture(autouse=True)
def fitted_once(network, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "toxicity_network", lambda docs, labels: network)


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, docs, folder[0]).columns == docs.columns
        assert stage(spark, docs.limit(0), folder[0]).count() == 0


def test_stages_with_clashing_columns(spark, folder):
    """Columns named as those the stages work with stay as they are, and change nothing."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    names = ["_gone", "_hit", "_key", "_sha", "sha", "toxicity", "copies", "own_rows", "key", "kept", "first", "_id", "score"]
    more = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, more, folder[0])
        assert got.columns == more.columns
        assert sorted(r.doc_id for r in got.collect()) == sorted(r.doc_id for r in stage(spark, docs, folder[0]).collect())
    spans = decontaminate.remove_spans(more, spark.read.parquet(f"{folder[0]}/benchmark.parquet"))
    assert spans.columns == more.columns and spans.count() == more.count()
    pieces = corpus_pipeline.pack(spark, more, folder[0])
    assert pieces.count() == corpus_pipeline.pack(spark, docs, folder[0]).count()


def test_run_on_empty_tables(spark, folder, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "toxicity_network", queries.toxicity_network)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run(spark, folder):
    path, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.drop_toxic(spark, docs, path).collect()}
    assert len(set(range(0, 150, 3)) - set(kept)) > 40 and len(set(range(150)) - set(range(0, 150, 3)) & set(kept)) > 90

    groups = {}
    for i, t in kept.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i))
    kept = {i: kept[i] for i in (min(g)[1] for g in groups.values())}
    sets = {i: {tuple((t or "").split()[k : k + 5]) for k in range(len((t or "").split()) - 4)} for i, t in kept.items()}
    gone = {b for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    item = passage.split()
    grams = {tuple(item[k : k + 10]) for k in range(3)}
    hit = {i for i, t in kept.items() if any(tuple((t or "").lower().split()[k : k + 10]) in grams for k in range(len((t or "").split())))}
    want = set(kept) - gone - hit
    assert 202 in gone and 210 in hit and 211 in want

    pieces = corpus_pipeline.run(spark, path).collect()
    assert {p.doc_id for p in pieces} == want
    for i in want:
        own = [p for p in pieces if p.doc_id == i]
        assert sum(p.length for p in own) == own[0].doc_tokens


def test_queries_run_on_these_tables(spark, folder):
    for name in ("op4_toxicity", "op7_language_id", "op9_lm_scoring"):
        assert queries.QUERIES[name](spark, folder[0]).count() == spark.read.parquet(f"{folder[0]}/documents.parquet").count()


def test_copies_without_an_identifier_go_alone(spark):
    texts = [(1, "one text"), (None, "one  text"), (None, "another"), (2, "a third"), (2, "one text")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    left = corpus_pipeline.drop_copies(spark, df, "").collect()
    assert sorted(r.text for r in left) == ["a third", "another", "one  text"]
