"""The pipeline against its stages done by brute force, and the SQL-backed queries against DuckDB."""

from __future__ import annotations

import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from frameloom.llm import quality_rules
from frameloom.llm.queries import QUERIES
from frameloom.llm.sql import ORACLE_SQL

from .conftest import words
from .test_operators import brute_lines, brute_ones, check_places

DATA = "/root/testdata/sf0.001"


def documents(seed=5):
    rng = random.Random(seed)
    texts = {}
    for i in range(40):
        texts[i] = "\n".join(" ".join(words(rng, rng.randrange(8, 30), 5000)) for _ in range(3))
    texts[40] = texts[3]
    w = texts[4].split(" ")
    w[len(w) // 2] = "changed"
    texts[41] = " ".join(w)
    texts[42] = "few words"
    texts[43] = " ".join(x + "###" for x in words(rng, 60))
    texts[44] = texts[5].split("\n")[0] + "\n" + " ".join(words(rng, 40, 5000))
    texts[45] = None
    return [(i, t, "en", "s", None if t is None else len(t)) for i, t in texts.items()], [(1, " ".join(texts[7].split()[4:18])), (2, "nowhere at all"), (3, None)]


def test_pipeline_by_brute_force(spark, tmp_path):
    docs, items = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(d[0], d[1]) for d in docs if not any(r(quality_rules.Text(d[1])) for r in quality_rules.RULES.values())]
    left = dict(brute_lines(kept).keys())
    left = {i: t for i, t in left.items() if t and t.strip()}
    ones = {i for i, _ in brute_ones(sorted(left.items()))}
    windows = [items[0][1].split()[s : s + 10] for s in range(5)]
    clean = {i for i in ones if not any(left[i].split()[p : p + 10] == g for g in windows for p in range(len(left[i].split())))}
    assert 7 in ones and 7 not in clean and 42 not in dict(kept) and 43 not in dict(kept) and 40 not in left
    found = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert {r[0] for r in found} == clean
    check_places(found)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs, items = documents()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, str(tmp_path))
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, empty, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert Counter(tuple(r[c] for c in columns) for r in QUERIES[name](spark, DATA).collect()) == Counter(want.fetchall())
