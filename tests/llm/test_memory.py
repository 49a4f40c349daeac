"""What a worker holds at a time, and after a task."""

import pyarrow as pa

import corpus_pipeline
from factloom.llm import piece_bpe
from factloom.llm.piece_bpe import PieceBpe, default_model

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_memos_go_when_a_task_ends(monkeypatch):
    bpe = PieceBpe(default_model())
    monkeypatch.setitem(piece_bpe._loaded, default_model(), bpe)
    texts = ["some words here\nand more", "  spaced  out", None, "some words again"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(4)), pa.array(texts)], ["doc_id", "_text"])
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    first = pa.Table.from_batches(piece_bpe.encode_batches(bpe, iter([batch]), names)).to_pylist()
    assert not bpe.words and not bpe.spans and not bpe.pairs and bpe.words.held == bpe.spans.held == 0
    broken = piece_bpe.encode_batches(bpe, iter([batch]), names)
    next(broken)
    assert bpe.words
    broken.close()  # a task that ends early
    assert not bpe.words
    assert pa.Table.from_batches(piece_bpe.encode_batches(bpe, iter([batch]), names)).to_pylist() == first
    assert [r["n_tokens"] for r in first] == [len(bpe.encode(t)) for t in texts]


def test_stages_hand_python_small_batches(spark):
    rows = spark.range(0, 6000, 1, 1).selectExpr("id AS doc_id", "concat('word number ', id, ' of a text') AS text", "'en' AS lang", "'s' AS source")
    before = spark.conf.get(KEY)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        for stage in ("language_id", "near_dedup", "tokens"):
            spark.conf.set(KEY, 10000)
            dict(corpus_pipeline.STAGES)[stage](spark, rows, "")
            got = [r.n for r in rows.mapInArrow(sizes, "n long").collect()]
            assert sum(got) == 6000 and max(got) <= 2000, stage
        spark.conf.set(KEY, 50)
        corpus_pipeline.tokens(spark, rows, "")
        assert spark.conf.get(KEY) == "50"  # smaller ones stay
    finally:
        spark.conf.set(KEY, before)
