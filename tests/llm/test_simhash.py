import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm.alike import BITS, SEGMENTS, proposal_plan
from factloom.llm.components import connected_components
from factloom.llm.simhash import STAGE, chain_filter, drop_near_duplicates, fingerprints_of, link_fingerprints, ring_keys, shingle_hashes, simhash_neardup

SCHEMA = "doc_id long, text string"


def fp(text, n=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


TEXTS = [None, "", " \t\n", "one", "One", "two words", "a b c", "A  b\nc", "é\xa0x É y z", "w " * 700, "x y z " * 400 + "q"]


def test_fingerprints_are_the_definition():
    got = fingerprints_of([shingle_hashes(t, 3) for t in TEXTS])
    assert [int.from_bytes(f.tobytes(), "big") for f in got] == [fp(t) for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=2, unique=True))
def test_close_fingerprints_share_a_chain(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    a = np.array([list(x.to_bytes(8, "big")), list(y.to_bytes(8, "big"))], np.uint8)
    keys = ring_keys(a, 16, 7)
    shared = (keys[0] == keys[1]).nonzero()[0]
    diff = np.repeat(a[:1] ^ a[1:], len(shared), axis=0)
    assert chain_filter(diff, shared, 16, 2).any()


def brute(rows, tau=2):
    ids = [i for i, _ in rows]
    f = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(f[i] ^ f[j]).count("1") <= tau or ids[i] == ids[j]:
                    low = min(ids[comp[i]], ids[comp[j]])
                    for k in (i, j):
                        if ids[comp[k]] > low:
                            comp[k] = ids.index(low)
                            changed = True
    return {(ids[i], f"{f[i]:016x}", ids[comp[i]]) for i in range(len(rows))}


def test_components_against_brute_force(spark):
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in that wood " * 6
    rows = list(enumerate(TEXTS)) + [(100 + i, base + f" tail{i}") for i in range(12)] + [(200, base), (201, base.upper())]
    docs = spark.createDataFrame(rows, SCHEMA)
    for block in (1024, 2):  # with 2 every bucket is dealt in blocks
        got = {(r.id, r.fp.hex(), r.component_id) for r in simhash_neardup(docs, block=block).collect()}
        assert got == brute(rows)


def test_rows_that_repeat_an_id_link_their_fingerprints(spark):
    a, b, c = "first text of some words", "another one that differs wholly", "third of them all and more"
    rows = [(3, a), (5, a), (5, b), (7, b), (9, c), (8, c), (9, a + " x y"), (20, a + " x y")]
    got = {(r.id, r.fp.hex(), r.component_id) for r in simhash_neardup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows) and {x for i, _, x in got if i in (3, 5, 7)} == {3} and {x for i, _, x in got if i in (8, 9, 20)} == {8}


def test_empty_table_and_null_ids(spark):
    assert simhash_neardup(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, "a b c d"), (1, "a b c d"), (None, "other words are here"), (1, "a b c d")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted((r.component_id or -1) for r in simhash_neardup(docs).collect()) == [-1, 1, 1, 1]
    assert sorted(r.text for r in drop_near_duplicates(docs).collect()) == ["a b c d"] * 3 + ["other words are here"]


def test_stage_keeps_one_of_a_group_and_clean_documents(spark):
    rng = np.random.default_rng(5)

    def text(n):
        return [f"w{x}" for x in rng.integers(0, 5000, n)]

    base, rows = text(400), []
    for i in range(30):  # near copies: two words of 400 changed
        w = list(base)
        w[i * 3], w[200 + i * 3] = f"new{i}", f"old{i}"
        rows.append((i, " ".join(w), "extra"))
    rows += [(100 + i, " ".join(text(200)), "extra") for i in range(60)]
    docs = spark.createDataFrame([(*r, "y") for r in rows], SCHEMA + ", fp string, drop string")
    kept = drop_near_duplicates(docs, **STAGE)
    assert kept.columns == docs.columns and {(r.fp, r["drop"]) for r in kept.collect()} == {("extra", "y")}
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 160)]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(1, 2), (3, 4), (2, 1), (7, 7)]])
def test_connected_components(spark, edges):
    got = dict(connected_components(spark.createDataFrame(edges, "src long, dst long")).collect())
    want = {x: x for e in edges for x in e}
    for _ in range(len(want)):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_fingerprints_propose_most_pairs_at_the_similarity(spark):
    """Recall of the fingerprints' links alone, without what the exact pass adds."""
    rng, sets = np.random.default_rng(3), []
    for _ in range(150):  # 100 and 100 hashes, 89 shared: 0.80
        common, own = rng.integers(0, 2**63, 89, np.uint64), rng.integers(0, 2**63, 22, np.uint64)
        sets += [np.concatenate([common, own[:11]]), np.concatenate([common, own[11:]])]
    fps = fingerprints_of(sets, BITS)
    tau, lead = proposal_plan(len(sets), 0.8)
    near = np.bitwise_count(fps[0::2] ^ fps[1::2]).sum(axis=1) <= tau
    reps = spark.createDataFrame([(i, f.tobytes()) for i, f in enumerate(fps)], "node long, fp binary")
    found = {(r.src // 2, r.dst // 2) for r in link_fingerprints(reps, tau, SEGMENTS, lead).collect()}
    assert near.mean() >= 0.9 and sum(a == b for a, b in found) >= 0.4 * len(near) and all(proposal_plan(10**k, 0.8)[1] <= 10 for k in range(14))


@pytest.mark.parametrize("block", [1024, 3])
def test_stage_finds_every_pair_at_the_similarity_and_no_other(spark, block):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(60):  # 100 words with 96 shingles; the copy shares 96 - k of them and has k of its own
        base = [f"g{g}w{x}" for x in range(100)]
        k = 8 + g % 6  # 96 - k of 96 + k: 0.846 down to 0.761
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[: 100 - k] + [f"g{g}x{x}" for x in range(k)]))]
    rows += [(200 + i, " ".join(f"v{x}" for x in rng.integers(0, 6, 40))) for i in range(40)] + [(300, "a b"), (301, "a  B"), (302, "repeat it " * 50), (303, "repeat it " * 500 + "repeat")]
    rows += [(None, "a b")]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, t in rows if i is not None for w in [t.lower().split()]}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                o = len(sets[i] & sets[j])
                if comp[i] > comp[j] and 5 * o >= 4 * (len(sets[i]) + len(sets[j]) - o):
                    comp[i], changed = comp[j], True
    want = sorted(i for i in comp if comp[i] == i)
    assert sum(i < 120 and comp[i] != i for i in comp) == 30
    kept = drop_near_duplicates(spark.createDataFrame(rows, SCHEMA), **STAGE, block=block)
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is not None, x)) == [None, *want]
