"""Every registered query with SQL against DuckDB on the smallest tables, compared like sorted rows."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import duckdb
import pytest

import __spark_entry__ as driver

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows, order):
    def one(x):
        return "~" if x is None or (isinstance(x, float) and math.isnan(x)) else str(x) if isinstance(x, bool) else repr(round(float(x), 6)) if isinstance(x, int | float) else str(x)

    return sorted(tuple(one(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_against_duckdb(spark, duck, sf, name):
    got = driver.queries()[name](spark, sf)
    want = duck.sql(driver.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    a = plain([tuple(r) for r in got.collect()], [got.columns.index(c) for c in columns])
    b = plain(want.fetchall(), [want.columns.index(c) for c in columns])
    assert a == b


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_sql_belongs_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_overlap_ratio_by_brute_force(spark, sf):
    """SQL has no such ratio: every pair of documents that shares enough words, compared in Python."""
    texts = {r.doc_id: r.text.split(" ") for r in spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL").collect()}
    sets = {k: set(w) - {""} for k, w in texts.items()}
    want = {}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and len(a & b) >= 0.6 * len(a | b) - 1e-9:
                ratio = SequenceMatcher(None, texts[i], texts[j], autojunk=False).ratio()
                if ratio >= 0.95:
                    want[i, j] = round(ratio, 3)
    got = {(r.i, r.j): r.ratio for r in driver.queries()["overlap_ratio"](spark, sf).collect()}
    assert got == pytest.approx(want) and got


def test_best_clone_match_exchanges_no_row_for_each_word(spark, tmp_path):
    """Words of 40 documents and their near copies stay packed in every exchange."""
    import random

    from tests.core.test_operators import _shuffled

    rng = random.Random(6)
    texts = []
    for _ in range(40):
        base = [f"v{rng.randrange(9000)}" for _ in range(300)]
        texts += [" ".join(base), " ".join(base[:-20]), " ".join(base[:-40])]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found, rows = _shuffled(spark, lambda: driver.queries()["best_clone_match"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = c.sql(driver.oracle_sql()["best_clone_match"])
    assert sorted((r.i, r.j) for r in found) == sorted(want.fetchall()) and len(found) == 80
    assert rows < sum(len(set(t.split(" "))) for t in texts) / 2


def test_knn_new_only_sends_a_vector_to_few_parts(spark, tmp_path, monkeypatch):
    """Vectors by fives in 120 blocks: what is exchanged does not grow with the number of blocks."""
    import random

    from sparkloupe.operators import similarity
    from tests.core.test_operators import _shuffled

    nearest = similarity.nearest
    monkeypatch.setattr(similarity, "nearest", lambda vectors: nearest(vectors, 3, 5))
    rng = random.Random(7)
    rows = [(k, [float(rng.randrange(-3, 4)) for _ in range(4)], f"label{k % 3}") for k in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    found, sent = _shuffled(spark, lambda: driver.queries()["knn_new_only"](spark, str(tmp_path)).collect())
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted((r.a, r.b) for r in found) == sorted(c.sql(driver.oracle_sql()["knn_new_only"]).fetchall())
    assert sent < 2 * 600 * (5 * 16 + 20)
