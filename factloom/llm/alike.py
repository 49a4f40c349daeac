"""SimHash near-duplicates verified by the similarity of their shingle sets, and completed.

Two documents are alike if their sets of shingles have a Jaccard similarity of `similarity` or
more. SimHash fingerprints with pigeonring filtering propose pairs, and each is verified on the
whole sets. At a similarity of 0.8 fingerprints of 64 bits differ in 10 bits on average, so no
budget that prunes finds every such pair. What fingerprints miss between documents that are not
joined yet is found exactly: all sets are ordered by one global order; two alike sets then share a
shingle among the first n - ceil(similarity * n) + 1 of each, so buckets by those shingles hold
every alike pair whatever the order is. Shingles are ordered by how many documents have one in
their slot, counted over all documents, so frequent ones come last, which keeps buckets small. Pairs whose parity bitmaps differ in more bits than the sets may
in shingles can't be alike; what is left is verified as well. Bitmaps have as many bits as their
sets have shingles, or else those of long texts would rule out nothing. Bitmaps and sets are joined
to pairs in parts of bounded bytes, and texts are filtered by ids that every executor has.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import collect_garbage, discard
from .common import BROADCAST_BYTES, block_pairs, key_runs, materialize, maybe_broadcast, pieces, run_lengths
from .components import connected_components
from .simhash import BLOCK, SEED, fingerprints_of, link_fingerprints, shingle_hashes

#: Slots, by the highest bits of their hashes, in which the shingles of all documents are counted, and blocks of slots.
#: They shape the order only: no pair is lost where a rare shingle shares a frequent one's slot.
SLOT_BITS, SLOT_BLOCKS = 22, 64
EPS = 1e-9
#: The fingerprints that propose pairs: bits, and the ring's segments.
BITS, SEGMENTS = 64, 16
#: Least bits of the parity bitmap of a set; each shingle flips one, so bitmaps differ in no more bits than sets in shingles.
PARITY = 1024
#: Pairs are looked up in parts of about this share of the bytes of all sets, and of so many bytes at least.
PART, PART_BYTES = 1 / 16, 256 << 20


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes as sorted signed numbers."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def set_digest(hashes: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])


def parity_bitmap(hashes: np.ndarray) -> np.ndarray:
    """One bit for each shingle or more, a power of two; the first half xor the second is the bitmap of half the bits."""
    bits = max(PARITY, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 0)
    return np.packbits((np.bincount(hashes & (bits - 1), minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def in_parts(pairs: DataFrame, weight: Column, limit: float, rows: int | None = None) -> Iterator[DataFrame]:
    """A table's pairs (a, b) in as many parts as keep the sum of `weight` in each at about `limit`, and the rows at `rows`."""
    n, total = pairs.agg(F.count("*"), F.sum(weight)).first()
    parts = max(1, math.ceil((total or 0) / limit), math.ceil(n / rows) if rows else 1)
    for i in range(parts):
        yield pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(parts)) == i) if parts > 1 else pairs


def possible_pairs(pairs: DataFrame, bitmaps: DataFrame, similarity: float, limit: float = PART_BYTES) -> DataFrame:
    """The pairs (a, b), with n_a and n_b, that sizes and bitmaps (node, size, bits) don't rule out; no alike pair goes."""
    for end in "ab":
        pairs = pairs.join(bitmaps.select(F.col("node").alias(end), F.col("size").alias(f"n_{end}")), end)
    sized = materialize(pairs.where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * similarity - EPS), "near-sized")
    # Sizes so near have bitmaps of equal length, or one has twice the other's.
    short = "least(size(bits_a), size(bits_b))"
    a, b = (f"if(size(bits_{e}) > {short}, zip_with(slice(bits_{e}, 1, {short}), slice(bits_{e}, {short} + 1, {short}), (x, y) -> x ^ y), bits_{e})" for e in "ab")
    differ = F.expr(f"aggregate(zip_with({a}, {b}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    kept = None
    for part in in_parts(sized, F.col("n_a") + F.col("n_b") + 2 * PARITY, 8 * limit):
        for end in "ab":
            part = part.join(bitmaps.select(F.col("node").alias(end), F.col("bits").alias(f"bits_{end}")), end)
        found = materialize(part.where(differ <= (F.col("n_a") + F.col("n_b")) * ((1 - similarity) / (1 + similarity)) + EPS).select("a", "b", "n_a", "n_b"), "near-possible")
        kept = found if kept is None else kept.union(found)
        collect_garbage(sized)
    discard(sized)
    return kept


def proposal_plan(rows: int, similarity: float) -> tuple[int, int]:
    """(tau, leading segments) for so many sets.

    tau is the expected distance at the similarity and 1.6 standard deviations. The key of the
    leading segments gets four bits more for every 16 times the rows, so buckets stay small.
    """
    differ = math.acos(2 * similarity / (1 + similarity)) / math.pi
    tau = BITS * differ + 1.6 * math.sqrt(BITS * differ * (1 - differ))
    return math.floor(tau), min(10, max(4, math.ceil((math.log2(max(rows, 2)) - 5) / (BITS // SEGMENTS))))


def prefix_length(n: int, similarity: float) -> int:
    return n - int(np.ceil(similarity * n - EPS)) + 1


def slots_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def slot_ranks(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each slot a byte that rises with its shingles, summed over the sets of all rows: 10 * log2(1 + n)."""
    width = (1 << SLOT_BITS) // SLOT_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for part in pieces(batch, 0):
                if part.num_rows:
                    np.add.at(n, slots_of(np.concatenate([shingle_set(t.as_py(), shingle) for t in part.column(0)])), 1)
        blocks = [(i, zlib.compress(b.tobytes(), 1)) for i, b in enumerate(n.reshape(SLOT_BLOCKS, width)) if b.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in blocks], pa.int32()), pa.array([b for _, b in blocks], pa.binary())], ["block", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1)):
                n = np.frombuffer(zlib.decompress(b.as_py()), np.uint32)
                sums[i] = sums[i] + n if i in sums else n.astype(np.int64)
        ranks = [np.minimum(10 * np.log2(1 + n), 255).astype(np.uint8).tobytes() for n in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(ranks, pa.binary())], ["block", "ranks"])

    out = np.zeros((SLOT_BLOCKS, width), np.uint8)
    for r in texts.select("text").mapInArrow(count, "block int, n binary").repartition("block").mapInArrow(add, "block int, ranks binary").collect():
        out[r.block] = np.frombuffer(r.ranks, np.uint8)
    return out.ravel()


def folded(bits: np.ndarray) -> bytes:
    """A parity bitmap folded to 256 bits, of which the same holds."""
    return np.bitwise_xor.reduce(bits.reshape(-1, 4), axis=0).tobytes()


def _pairs(rows: DataFrame, similarity: float, neighbours: bool = False) -> DataFrame:
    """Distinct (a, b) proposed by buckets (key, lo, hi) of (node, size, at, label, fold).

    All pairs whose labels differ are looked at, or with `neighbours` only those next to each
    other by size. A pair is kept in a bucket if what follows there can still make up the overlap
    it needs, which holds for alike pairs in the bucket of the first shingle they share, and if
    the folded bitmaps don't rule it out, so what is kept doesn't grow with the square of a bucket.
    """
    keys, need, most = ["key", "lo", "hi"], similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in key_runs(batches, keys):
            _, lengths = run_lengths(table, keys)
            node, n, at, label = (table.column(c).to_numpy() for c in ("node", "size", "at", "label"))
            fold = np.frombuffer(b"".join(table.column("fold").to_pylist()), np.uint64).reshape(len(node), -1)
            left = np.repeat(lengths.cumsum(), lengths) - np.arange(len(node))  # rows up to the end of the run
            rest, rows, shift = n - at, np.arange(len(node)), 1
            while True:
                rows = rows[left[rows] > shift]
                rows = rows[n[rows] >= similarity * n[rows + shift] - EPS]  # sizes rise within a run: further ones are too large as well
                if not len(rows):
                    break
                for i in range(0, len(rows), 200_000):
                    a = rows[i : i + 200_000]
                    b = a + shift
                    ok = (np.minimum(rest[a], rest[b]) + EPS >= need * (n[a] + n[b])) & (label[a] != label[b]) & (node[a] != node[b])
                    a, b = a[ok], b[ok]
                    ok = np.bitwise_count(fold[a] ^ fold[b]).sum(axis=1) <= most * (n[a] + n[b]) + EPS
                    a, b = node[a[ok]], node[b[ok]]
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
                if neighbours:
                    break
                shift += 1

    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "size", "node")
    return rows.mapInArrow(compare, "a long, b long").distinct()


def alike_links(docs: DataFrame, reps: DataFrame, sets_once: DataFrame, buckets: DataFrame, shingle: int, similarity: float, block: int) -> DataFrame:
    """(src, dst) over ids: verified links with the components of all alike pairs.

    The links that fingerprints propose come first, with neighbours by size in each bucket; pairs
    that these join already need no check of their own, so a dense group of g sets is not
    checked g * g / 2 times.
    """
    bitmaps = sets_once.select("node", "size", "bits")
    limit = max(PART_BYTES, 8 * PART * (sets_once.agg(F.sum("size")).first()[0] or 0))
    hot = materialize(buckets.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block), "near-hot")
    collect_garbage(hot)
    dealt = block_pairs(buckets, maybe_broadcast(hot), block)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "lo", "hi"]
        for table in key_runs(batches, keys):
            _, lengths = run_lengths(table, keys)
            live = np.repeat(lengths > 1, lengths).nonzero()[0]
            if len(live):
                yield from table.take(pa.array(live)).combine_chunks().to_batches()

    dealt = dealt.select("key", "node", "size", "at", "lo", "hi").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rows = live = materialize(dealt.mapInArrow(alone, "key long, node long, size long, at long, lo int, hi int"), "near-live")
    discard(hot)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0):
                found = [shingle_set(t.as_py(), shingle) for t in part.column(0)]
                yield pa.RecordBatch.from_arrays([pa.array([set_digest(s) for s in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["node", "s"])

    def verified_part(pairs: DataFrame, name: str) -> DataFrame:
        nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        wanted = materialize(reps.join(nodes, "node", "left_semi").select("node", "id"), f"near-wanted-{name}")
        ids = F.broadcast(wanted.select(F.col("id").alias("_id")).distinct())  # at most BROADCAST_BYTES, or else whole texts would be shuffled
        texts = docs.join(ids, docs.id == F.col("_id"), "left_semi").select("text")
        # An id may have further rows with other texts: only the wanted sets stay, each once.
        found = texts.mapInArrow(sets, "node long, s array<long>").join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])
        found = materialize(found, f"near-sets-{name}")
        both = pairs.select("a", "b").join(found.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(found.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
        both = both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("o"), (F.size("sa") + F.size("sb")).alias("t"))
        both = materialize(both.where(F.col("o") + EPS >= (F.col("t") - F.col("o")) * similarity).select("a", "b"), f"near-links-{name}")
        discard(wanted, found)
        return both

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        parts = in_parts(pairs, 8 * (F.col("n_a") + F.col("n_b")), limit, BROADCAST_BYTES // 32)
        return reduce(DataFrame.union, [verified_part(part, name) for part in parts])

    tau, lead = proposal_plan(sets_once.count(), similarity)
    proposed = link_fingerprints(sets_once.where("size > 0").select("node", "fp"), tau, SEGMENTS, lead, block)
    proposed = by_print = materialize(proposed.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), "near-by-print")
    collect_garbage(by_print)
    live = live.join(sets_once.select("node", "fold"), "node")
    proposed = proposed.union(_pairs(live.withColumn("label", F.col("node")), similarity, True)).distinct()
    proposed = materialize(proposed, "near-proposed")
    discard(by_print)
    first = materialize(possible_pairs(proposed, bitmaps, similarity, limit), "near-pairs-first")
    discard(proposed)
    links = verified(first, "first")
    label = connected_components(links, "a", "b").select("node", F.col("component").alias("label"))
    labelled = live.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    further = materialize(_pairs(labelled, similarity).join(first.select("a", "b"), ["a", "b"], "left_anti"), "near-further")
    discard(rows)
    left = materialize(possible_pairs(further, bitmaps, similarity, limit), "near-pairs-further")
    discard(further)
    links = links.union(verified(left, "further"))
    discard(first, left)
    return links.join(reps.select(F.col("node").alias("a"), F.col("id").alias("src")), "a").join(reps.select(F.col("node").alias("b"), F.col("id").alias("dst")), "b").select("src", "dst")


def alike_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(id, component_id) of the ids that are alike to others, smallest ids as components.

    Texts without words have the empty set, which is alike to itself only. Rows that repeat an id
    share its component; rows without an id take no part. Sets are compared by 64-bit hashes of
    their shingles, and equal sets told by a 64-bit digest.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    ranks = slot_ranks(docs, shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                found, nodes, sizes, bits, folds, firsts = [shingle_set(t.as_py(), shingle) for t in part.column(1)], [], [], [], [], []
                fps = fingerprints_of([s.view(np.uint64) for s in found], BITS)
                for s in found:
                    nodes.append(set_digest(s))
                    sizes.append(len(s))
                    bits.append(parity_bitmap(s))
                    folds.append(folded(bits[-1]))
                    s = s[np.argsort(ranks[slots_of(s)], kind="stable")]
                    firsts.append(s[: prefix_length(len(s), similarity)])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array([f.tobytes() for f in fps], pa.binary()), pa.array(folds, pa.binary()), pa.array(bits, pa.list_(pa.int64())), pa.array(firsts, pa.list_(pa.int64()))],
                    ["id", "node", "size", "fp", "fold", "bits", "first"],
                )

    rows = materialize(docs.mapInArrow(run, "id long, node long, size long, fp binary, fold binary, bits array<long>, first array<long>"), "near-rows")
    # Of equal sets one row goes into the buckets, that of the smallest id.
    row = F.struct(*[c for c in rows.columns if c != "node"])
    one = materialize(rows.groupBy("node").agg(F.min_by(row, "id").alias("row")).select("node", "row.*"), "near-one")
    reps = one.select("node", "id")
    copies = rows.select("node", F.col("id").alias("dst")).join(reps, "node").where("id <> dst").select(F.col("id").alias("src"), "dst").distinct()
    copies = materialize(copies, "near-copies")
    discard(rows)
    buckets = one.select("node", "size", F.posexplode("first").alias("at", "key")).select("key", "node", "size", F.col("at").cast("bigint").alias("at"))
    links = materialize(alike_links(docs, reps, one.select("node", "size", "fp", "fold", "bits"), buckets, shingle, similarity, block), "near-linked")
    discard(one)
    return connected_components(links.union(copies)).select(F.col("node").alias("id"), F.col("component").alias("component_id"))
