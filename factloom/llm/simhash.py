"""Operator 1: SimHash near-duplicate detection with pigeonring filtering.

The fingerprint is a ring of `segments` equal segments. If two fingerprints differ in at most
tau bits, then by the pigeonring principle some start exists from which every chain of l
consecutive segments differs in at most l * tau / segments bits. The first `lead` segments of
such a chain serve as an exact key, the further ones prune candidates by cumulative
differences, and what is left gets the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import block_pairs, key_runs, local_components, materialize, maybe_broadcast, pieces, read_table, run_lengths
from .components import connected_components

SEED = 42
#: Rows of a bucket above which it is dealt into blocks.
BLOCK = 1024


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of `shingle` words; of all words if there are fewer."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z and the six white-space bytes only
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(shingle))))], np.uint64)


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """A further 64-bit hash of each value (splitmix64 finaliser); lane 0 is the value itself."""
    if not lane:
        return h
    z = h + np.uint64(lane * 0x9E3779B97F4A7C15 % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprints_of(hashes: list[np.ndarray], bits: int = 64) -> np.ndarray:
    """Majority bits of each document's hashes, as bytes with the highest bit first."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    out = np.zeros((len(hashes), bits // 8), np.uint8)
    full = lengths.nonzero()[0]
    if not len(full):
        return out
    flat, sizes = np.concatenate([hashes[i] for i in full]), lengths[full]
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # Byte-wide counters packed in 64-bit words hold at most 255 hashes at a time.
    pieces = [np.arange(b, b + n, 255) for b, n in zip(begin, sizes)]
    first = np.concatenate([[0], np.cumsum([len(p) for p in pieces])[:-1]])
    cuts, ones = np.concatenate(pieces), np.uint64(0x0101010101010101)
    for lane in range(bits // 64):
        h, counts = _mixed(flat, lane), np.empty((len(full), 64), np.int64)
        for b in range(8):
            packed = np.add.reduceat((h >> np.uint64(b)) & ones, cuts)
            counts[:, b::8] = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        set_ = counts * 2 > sizes[:, None]
        out[full, lane * 8 : lane * 8 + 8] = np.packbits(set_[:, ::-1], axis=1)
    return out


def simhash_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64) -> DataFrame:
    """(id, fp binary) of every row; null and wordless texts get all zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                fps = fingerprints_of([shingle_hashes(t.as_py(), shingle) for t in part.column(1)], bits)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f.tobytes() for f in fps], pa.binary())], ["id", "fp"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("fp", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def ring_keys(fps: np.ndarray, segments: int, lead: int) -> np.ndarray:
    """For each fingerprint and start: the start and the `lead` segments from there, in one number."""
    bits, n = fps.shape[1] * 8, len(fps)
    width, take = bits // segments, bits // segments * lead
    if take > 40:
        raise ValueError("the leading segments hold more than 40 bits")
    ring = np.unpackbits(fps, axis=1)
    ring = np.concatenate([ring, ring[:, :take]], axis=1)
    weights = 1 << np.arange(take - 1, -1, -1, dtype=np.int64)
    keys = np.empty((n, segments), np.int64)
    for s in range(segments):
        keys[:, s] = ring[:, s * width : s * width + take].astype(np.int64) @ weights + (s << 40)
    return keys


def chain_filter(x: np.ndarray, starts: np.ndarray, segments: int, tau: int) -> np.ndarray:
    """Which differences x (n by bytes) keep the budget of every chain from their start on."""
    bits = x.shape[1] * 8
    per = np.unpackbits(x, axis=1).reshape(len(x), segments, bits // segments).sum(axis=2, dtype=np.int16)
    ring = np.take_along_axis(per, (starts[:, None] + np.arange(segments)) % segments, axis=1).cumsum(axis=1)
    budget = np.arange(1, segments + 1) * tau // segments
    return (ring <= budget).all(axis=1)


def link_fingerprints(reps: DataFrame, tau: int, segments: int, lead: int, block: int = BLOCK) -> DataFrame:
    """(src, dst) of links between distinct fingerprints (node, fp) at most tau bits apart.

    Of each bucket only a spanning forest of its links is returned: the components are those of
    all links, and a dense bucket of g fingerprints gives fewer than g rows. All pairs are found
    if lead * tau < segments; beyond that a pair is found where some `lead` segments agree.
    """

    def keyed(with_fp: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    fps = np.frombuffer(b"".join(part.column("fp").to_pylist()), np.uint8).reshape(part.num_rows, -1)
                    keys = pa.array(ring_keys(fps, segments, lead).ravel())
                    if with_fp:
                        many = pa.array(np.repeat(np.arange(part.num_rows), segments))
                        yield pa.RecordBatch.from_arrays([keys, part.column("node").take(many), part.column("fp").take(many)], ["key", "node", "fp"])
                    else:
                        yield pa.RecordBatch.from_arrays([keys], ["key"])

        return run

    def joined(label: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        own = (label != np.arange(len(label))).nonzero()[0]
        return local_components(len(label), np.concatenate([*a, own]), np.concatenate([*b, label[own]]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "lo", "hi"]
        for table in key_runs(batches, keys):
            starts, lengths = run_lengths(table, keys)
            live = np.repeat(lengths > 1, lengths).nonzero()[0]  # rows that are not alone
            if not len(live):
                continue
            table = table.take(pa.array(live)).combine_chunks()
            lengths = lengths[lengths > 1]
            node, start = table.column("node").to_numpy(), table.column("key").to_numpy() >> 40
            fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint8).reshape(len(node), -1)
            words = fps.view(np.uint64)
            left = np.repeat(lengths.cumsum(), lengths) - np.arange(len(node))  # rows up to the end of the run
            label, rows, shift, a_all, b_all, held = np.arange(len(node)), np.arange(len(node)), 1, [], [], 0
            while True:
                rows = rows[left[rows] > shift]
                if not len(rows):
                    break
                for at in range(0, len(rows), 200_000):
                    a = rows[at : at + 200_000]
                    b = a + shift
                    near = (np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= tau) & (label[a] != label[b])
                    a, b = a[near], b[near]
                    if len(a):
                        ok = chain_filter(fps[a] ^ fps[b], start[a], segments, tau)
                        a_all.append(a[ok])
                        b_all.append(b[ok])
                        held += len(a_all[-1])
                if held > 500_000:
                    label, a_all, b_all, held = joined(label, a_all, b_all), [], [], 0
                shift += 1
            if held:
                label = joined(label, a_all, b_all)
            moved = (label != np.arange(len(node))).nonzero()[0]
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(node[label[moved]]), pa.array(node[moved])], ["src", "dst"])

    hot = reps.select("node", "fp").mapInArrow(keyed(False), "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = maybe_broadcast(materialize(hot, "simhash-hot"))
    rows = block_pairs(reps.select("node", "fp").mapInArrow(keyed(True), "key long, node long, fp binary"), hot, block)
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return rows.mapInArrow(compare, "src long, dst long").distinct()


def simhash_neardup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bits: int = 64, tau: int = 2, segments: int = 16, lead: int = 7, block: int = BLOCK
) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id reachable by links.

    Rows whose text is null, empty or white space have fingerprint zero, which links like any
    other. Rows that repeat an id share its component; a null id keeps its own fingerprint, and
    its component is that of the fingerprint (null if no row with an id has it). Texts are taken
    whole. An empty table gives no rows.
    """
    fps = materialize(simhash_fingerprints(docs, id_col, text_col, shingle, bits), "simhash-fps")
    reps = materialize(fps.where("id is not null").groupBy("fp").agg(F.min("id").cast("bigint").alias("node")), "simhash-reps")
    links = link_fingerprints(reps, tau, segments, lead, block)
    # An id with several fingerprints links them.
    several = fps.where("id is not null").groupBy(F.col("id").cast("bigint").alias("several")).agg(F.min("fp").alias("low"), F.max("fp").alias("high")).where("low <> high").select("several")
    several = fps.join(several, F.col("id") == F.col("several"), "left_semi").join(reps, "fp").select("node", F.col("id").cast("bigint").alias("id")).distinct()
    comps = connected_components(links.union(several))
    by_fp = reps.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(materialize(by_fp, "simhash-components"), "fp", "left").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """The rows of `docs` without the near copies: of each group the smallest id stays.

    With a `similarity`, groups are those of documents whose sets of shingles overlap that much:
    pairs of close fingerprints are verified, and what fingerprints miss is added (`alike.py`);
    else those of close fingerprints. Of rows that repeat the smallest id all stay, and so do
    rows with a null id, which nothing names. Columns are those of `docs`.
    """
    from .alike import alike_components

    id_col = how.get("id_col", "doc_id")
    found = alike_components(docs, **how) if "similarity" in how else simhash_neardup(docs, **how)
    drop = materialize(found.where("id <> component_id").select("id").distinct(), "simhash-drop")
    return docs.join(drop, docs[id_col] == drop["id"], "left_anti")


#: The pipeline stage: documents with a Jaccard similarity of 0.8 or more on five-word shingles.
STAGE = {"shingle": 5, "similarity": 0.8}


def op1_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = simhash_neardup(read_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
