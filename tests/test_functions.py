import os
import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.functions.clock import HybridClock
from factloom.functions.codec import canonical_bytes, decode_fact, encode_fact
from factloom.functions.provenance import from_keyword, keyword
from factloom.functions.signing import public_key, sign, verify
from factloom.types import BIGDEC, BIGINT, BOOL, BYTES, CorruptionError, DOUBLE, FactError, INSTANT, KEYWORD, LONG, REF, STRING, UUID, TxId, big_bytes, big_int, node_id
from tests.helpers import eid, fact, frame

VALUES = st.one_of(
    st.tuples(st.sampled_from([KEYWORD, STRING]), st.text(max_size=20)),
    st.tuples(st.sampled_from([LONG, INSTANT]), st.integers(-(2**63), 2**63 - 1)),
    st.tuples(st.just(DOUBLE), st.floats(allow_nan=False)),
    st.tuples(st.just(BOOL), st.booleans()),
    st.tuples(st.just(UUID), st.binary(min_size=16, max_size=16)),
    st.tuples(st.just(REF), st.binary(min_size=32, max_size=32)),
    st.tuples(st.just(BYTES), st.binary(max_size=40)),
    st.tuples(st.sampled_from([BIGINT, BIGDEC]), st.integers(-(2**127), 2**127 - 1)),
)


@settings(max_examples=300, deadline=None)
@given(VALUES, st.text(max_size=10), st.integers(0, 2**63 - 1), st.integers(0, 2**32 - 1), st.integers(0, 1))
def test_bytes_round_trip_and_are_strict(tv, a, phys, log, op):
    data = encode_fact(eid("x"), a, tv[0], tv[1], (phys, log, node_id(1)), op)
    assert decode_fact(data) == (eid("x"), a, tv[0], tv[1], (phys, log, node_id(1)), op)
    for bad in (data + b"\0", data[:-1], data[:-1] + b"\2"):
        with pytest.raises(CorruptionError):
            decode_fact(bad)


def test_columns_give_the_same_bytes(spark):
    r = random.Random(1)
    doubles = [0.0, -0.0, 1.0, -1.5, float("inf"), -float("inf"), 5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, 0.1, 2**53 + 0.0, 1 - 2**-53] + [struct.unpack("<d", os.urandom(8))[0] for _ in range(200)]
    cases = [(DOUBLE, x) for x in doubles if x == x] + [(LONG, x) for x in (0, -1, 2**63 - 1, -(2**63))] + [(BOOL, True), (STRING, "é😀"), (KEYWORD, ""), (BYTES, b"\1\2"), (UUID, bytes(16)), (REF, eid("y")), (INSTANT, -5)]
    cases += [(BIGINT, x) for x in (0, 1, -1, 2**127 - 1, -(2**127), r.getrandbits(100))]
    rows = [fact("x", "a/b", int(v) if t == BOOL else v, i, i, 3, i % 2, tag=t) for i, (t, v) in enumerate(cases)]
    got = {x.tx_phys: bytes(x.b) for x in frame(spark, rows).select("tx_phys", canonical_bytes().alias("b")).collect()}
    for i, (t, v) in enumerate(cases):
        assert got[i] == encode_fact(eid("x"), "a/b", t, v, (i, i, node_id(3)), i % 2), (t, v)


def test_big_numbers_order_as_bytes():
    xs = [-(2**127), -1, 0, 1, 2**127 - 1]
    assert sorted(map(big_bytes, xs)) == list(map(big_bytes, xs)) and [big_int(big_bytes(x)) for x in xs] == xs


def test_clock():
    now = iter([5, 5, 3, 9, 9])
    clock = HybridClock(node_id(1), lambda: next(now))
    ticks = [clock.tick() for _ in range(4)]
    assert ticks == sorted(set(ticks)) and ticks[-1] == TxId(9, 0, node_id(1))
    assert clock.receive(TxId(50, 7, node_id(2))) == TxId(50, 8, node_id(1))
    stuck = HybridClock(node_id(1), lambda: 5, patience=0.01)
    stuck.phys, stuck.log = 5, 2**32 - 1
    with pytest.raises(FactError):
        stuck.tick()


def test_signatures():
    # The first test of RFC 8032.
    secret = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    key = bytes.fromhex("d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a")
    assert public_key(secret) == key
    s = sign(secret, b"")
    assert s.hex().startswith("e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bac")
    assert verify(key, b"", s) and not verify(key, b"x", s) and not verify(key, b"", s[:-1] + b"\0")


def test_provenance():
    assert from_keyword(keyword("derived")) == "derived" and from_keyword("provenance/none") is None
