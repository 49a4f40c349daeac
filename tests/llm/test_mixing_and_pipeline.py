import math
import re

import pytest
from pyspark.sql import functions as F

from factloom.llm.mixing import _Mix, mix_sources, mixed_documents, word_count
from factloom.llm.queries import ORACLE_SQL, QUERIES
from tests.helpers import SF, duck, rows_of

SCHEMA = "doc_id long, text string, source string, target string"


def test_targets_and_sizes(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 4}", "x") for i in range(200)] + [(1000, None, None, "x"), (1001, "a b", None, "x"), (1002, "", "zz", "x"), (5, "w w", "s1", "x")]
    got = mix_sources(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    size = {}
    for i, t, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted([s for s in size if s is not None]) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while True:  # the excess goes round until none is above
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= over
    target |= share
    taken = {}
    for r in got:
        assert r.source_size == size[r.source] and math.isclose(r.target, target[r.source], abs_tol=1e-9) and r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 7
    again = mix_sources(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixed_documents_and_empty_tables(spark):
    rows = [(i, "w " * (1 + i % 5), f"s{i % 3}", "x") for i in range(60)] + [(1, "w w", "s1", "x")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in mix_sources(docs).where("taken > 0 or copies > 0").collect())
    empty = docs.limit(0)
    assert mix_sources(empty).count() == mixed_documents(empty).count() == 0


def test_capped_sources_rank_nothing_and_no_document_is_over_its_cap(spark):
    rows = [(i, "w " * (i % 4), "big", "x") for i in range(2000)] + [(5000 + i, "v " * (i % 3), "small", "x") for i in range(30)] + [(9000, "", "void", "x"), (9001, None, "void", "x")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.copies <= 3 for r in got)
    small = [r for r in got if r.source == "small"]
    assert {r.copies for r in small} == {3} and sum(r.taken for r in small) == 3 * small[0].source_size == small[0].target
    assert {r.copies for r in got if r.source == "void"} == {0}
    mix = _Mix(docs.select(F.col("doc_id").alias("id"), F.col("source").alias("src"), word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("th"), F.lit(1.0).alias("odds")), (1, 2, 3), 3.0)
    assert {r.src for r in mix.close.collect()} <= {"big"}
    copies = {}
    for r in mixed_documents(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.copies for r in got if r.copies}


def test_one_id_or_one_text_for_all_rows_is_counted_not_sorted(spark):
    rows = [(7, "a b c", "s", "x")] * 500 + [(7, f"t{i} u", "s", "x") for i in range(40)] + [(i, "q", "t", "x") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mix_sources(docs).collect()
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert len(got) == len(rows) and all(abs(taken[r.source] - r.target) <= 2 for r in got)
    out = mixed_documents(docs).collect()
    assert len(out) == sum(r.copies for r in got) and sum(r.source == "s" for r in out) == sum(r.copies for r in got if r.source == "s")


def test_names_of_other_columns_may_clash(spark):
    names = "doc_id long, text string, source string, src string, id string, copies string, extra string, row string"
    docs = spark.createDataFrame([(i, "w w", f"s{i % 2}", "a", "b", "c", "d", "e") for i in range(40)], names)
    out = mixed_documents(docs)
    assert out.columns == docs.columns and {r[3:] for r in out.collect()} == {("a", "b", "c", "d", "e")}


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, SF).toPandas()) == rows_of(duck().sql(ORACLE_SQL[name]).df())


def test_pipeline_stage_by_stage(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), docs.schema)
        kept[name] = docs.count()
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert kept["language_id"] >= 0.9 * len(ids) and kept["line_dedup"] >= kept["near_dedup"] > 0.5 * len(ids)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    whole = corpus_pipeline.run(spark, SF).collect()
    assert sorted(map(tuple, last), key=str) == sorted(map(tuple, whole), key=str)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, r.text)
    assert all(r.n_tokens >= len(re.findall(r"\S+", texts[r.doc_id])) for r in last)
