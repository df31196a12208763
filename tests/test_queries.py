"""Every registered query of the library against its SQL equivalent in DuckDB, on the smallest given tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from shelfmark.queries import ORACLE_SQL, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return con


def rows(df):
    def cell(v):
        if pd.isna(v):
            return None
        return round(float(v), 6) if isinstance(v, numbers.Number) and not isinstance(v, bool) else str(v)

    return sorted((tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_scores_without_sql(spark):
    with_sql = set(ORACLE_SQL)
    assert set(QUERIES) - with_sql == {"train_score"}


@pytest.mark.parametrize("name", ["scan_by_extension", "gpx_match", "dup_exact_groups"])
def test_no_plan_crosses_tables_or_uses_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Pandas" not in plan


@pytest.mark.parametrize("name", ["near_text_summary", "near_text_uncovered"])
def test_near_texts_write_no_list_of_pairs(spark, tmp_path, monkeypatch, name):
    """All hashes of 200 texts are near each other; what the similar half writes grows with the texts, not with their pairs."""
    from pyspark.sql import functions as F

    from shelfmark.operators import similar

    texts = pd.DataFrame({"doc_id": range(200), "source": "s", "text": [f"text {i // 2 if i < 10 else i}" for i in range(200)]})
    spark.createDataFrame(texts.assign(n_chars=texts.text.str.len())).write.parquet(str(tmp_path / "documents.parquet"))
    hashes = lambda t: t.select("task_id", "file_id", F.expr("shiftleft(1L, int(file_id % 40)) | shiftleft(1L, int(40 + file_id div 40))").alias("h"))
    monkeypatch.setattr(similar, "simhashes", hashes)
    write, sizes = similar.staged, []

    def counted(*args, **how):
        sizes.append((out := write(*args, **how)).count())
        return out

    monkeypatch.setattr(similar, "staged", counted)
    got = sorted(tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect())
    # ten texts are five exact pairs; the similar group has others too, so it is not covered
    assert got == ([(1, 200, "similar"), (5, 10, "exact")] if name == "near_text_summary" else [(0, i) for i in range(200)])
    assert max(sizes) <= 5 * 200 < 200 * 199 // 2
