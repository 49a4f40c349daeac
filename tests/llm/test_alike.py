import numpy as np
from pyspark.sql import functions as F

from factloom.llm import alike
from factloom.llm.alike import alike_components, parity_bitmap, possible_pairs, shingle_set, slot_ranks, slots_of

SCHEMA = "doc_id long, text string"


def test_bitmaps_rule_out_long_unlike_sets_and_no_alike_ones(spark):
    rng, rows, pairs = np.random.default_rng(4), [], []
    for n in (900, 1020, 3000, 4090, 20_000):  # the copy of 1020 and of 4090 has twice the bits
        base = rng.integers(-(2**63), 2**63 - 1, n)
        copy = np.concatenate([base, rng.integers(-(2**63), 2**63 - 1, n // 5)])
        for s in (base, copy, rng.integers(-(2**63), 2**63 - 1, n)):
            rows.append((len(rows), len(s), parity_bitmap(s).tolist()))
        k = len(rows) - 3
        pairs += [(k, k + 1), (k, k + 2)]
    bitmaps = spark.createDataFrame(rows, "node long, size long, bits array<long>")
    left = possible_pairs(spark.createDataFrame(pairs, "a long, b long"), bitmaps, 0.8)
    assert sorted((r.a, r.b) for r in left.collect()) == [p for p in pairs if p[1] == p[0] + 1]


def test_pairs_in_parts_have_the_same_components(spark, monkeypatch):
    rows = []
    for g in range(20):  # the copy shares 96 - k shingles of 96 + k: 0.846 down to 0.761
        base, k = [f"g{g}w{x}" for x in range(100)], 8 + g % 6
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: 100 - k] + [f"g{g}x{x}" for x in range(k)]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, alike_components(docs).collect()))
    assert whole == sorted((2 * g + e, 2 * g) for g in range(20) if g % 6 < 3 for e in (0, 1))
    parts, in_parts = [], alike.in_parts

    def counted(*a):
        found = list(in_parts(*a))
        parts.append(len(found))
        return found

    monkeypatch.setattr(alike, "in_parts", counted)
    monkeypatch.setattr(alike, "PART", 0)
    monkeypatch.setattr(alike, "PART_BYTES", 6000)  # about four pairs
    assert sorted(map(tuple, alike_components(docs).collect())) == whole and max(parts) > 2


    pairs = spark.range(100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    parts = list(alike.in_parts(pairs, F.lit(1), 1e9, 30))
    assert len(parts) == 4 and sorted(r.a for p in parts for r in p.collect()) == list(range(100))


def test_shingles_are_counted_in_all_documents(spark):
    texts = [None, "", "a b"] + [f"one passage of six words here and own{i} more{i} of it{i}" for i in range(5)] + [f"t{i} u{i} v{i} w{i} x{i} y{i}" for i in range(1000)]
    want = np.zeros(1 << alike.SLOT_BITS, np.int64)
    for t in texts:
        np.add.at(want, slots_of(shingle_set(t, 5)), 1)
    ranks = slot_ranks(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5), 5)
    assert (ranks == (10 * np.log2(1 + want)).astype(np.uint8)).all()
    passage = slots_of(shingle_set("one passage of six words", 5))  # in five documents, which no sample told of
    assert (ranks[passage] > ranks[slots_of(shingle_set("t7 u7 v7 w7 x7", 5))]).all()
    assert not slot_ranks(spark.createDataFrame([], "text string"), 5).any()
