"""Content-addressed trees of sorted key-value pairs: build, read, diff, transfer, proofs.

A chunk ends after a key whose gear hash has its lowest bits set, but has `MIN_ENTRIES` entries at
least and `MAX_ENTRIES` at most, so boundaries follow from the sorted keys alone and equal contents
give equal trees whatever their history. Where a chunk ends depends on where the one before did;
range partitions tell for each of the possible numbers of entries since the last boundary how
they would go on, the driver strings these tables together (one a partition), and then all
partitions are cut at once, each as a stream. Parents are built the same way over (first key, address) of the children.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import discard, materialize
from ..types import ChunkError, CorruptionError

#: A key's hash ends a chunk with probability 1 / 2 ** WIDTH.
WIDTH = 8
MIN_ENTRIES, MAX_ENTRIES = 32, 1024
KINDS = ["primary", "live", "schema", "frontier", "meta"]
#: Entries of one range partition, about.
PART_ENTRIES = 250_000
#: Keys that are hashed at once, and entries that a worker gathers before it sends chunks on.
HASH_KEYS, SENT_ENTRIES = 4096, 8192

LEAF, INNER = 1, 2
ENTRIES = "array<struct<key:binary,value:binary>>"
_GEAR = np.array([int.from_bytes(hashlib.sha256(b"gear/" + bytes([b])).digest()[:8], "little") for b in range(256)], np.uint64)


# hashes and codecs


def gear_hashes(keys: list[bytes]) -> np.ndarray:
    """For each key the hash that rotates left by one bit and takes in a byte's number, byte by byte.

    Several numbers of 8 bytes are held for each byte of a key, and so only for `HASH_KEYS` at a time.
    """
    return np.concatenate([np.zeros(0, np.uint64), *[_gear_hashes(keys[at : at + HASH_KEYS]) for at in range(0, len(keys), HASH_KEYS)]])


def _gear_hashes(keys: list[bytes]) -> np.ndarray:
    lengths = np.array([len(k) for k in keys], np.int64)
    out = np.zeros(len(keys), np.uint64)
    full = lengths.nonzero()[0]
    if len(full):
        flat = np.frombuffer(b"".join(keys), np.uint8)
        ends = np.cumsum(lengths[full])
        turn = ((np.repeat(ends, lengths[full]) - 1 - np.arange(len(flat))) % 64).astype(np.uint64)
        x = _GEAR[flat]
        x = (x << turn) | (x >> ((np.uint64(64) - turn) % np.uint64(64)))
        out[full] = np.bitwise_xor.reduceat(x, ends - lengths[full])
    return out


def boundary_keys(keys: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Which keys' hashes end a chunk, if its size allows."""
    mask = np.uint64((1 << width) - 1)
    return gear_hashes(keys) & mask == mask


def encode_chunk(level: int, entries: list[tuple[bytes, bytes]]) -> bytes:
    """The bytes of a chunk: a leaf's keys and values, or a parent's first keys and addresses."""
    u32 = struct.Struct("<I").pack
    head = bytes([LEAF]) if level == 0 else bytes([INNER, level])
    return b"".join([head, u32(len(entries)), *(x for k, v in entries for x in ((u32(len(k)), k, u32(len(v)), v) if level == 0 else (u32(len(k)), k, v)))])


def decode_chunk(data: bytes) -> tuple[int, list[tuple[bytes, bytes]]]:
    """(level, entries) of a chunk's bytes; anything but one whole canonical chunk is an error."""
    if not data:
        raise ChunkError("an empty chunk")
    if data[0] not in (LEAF, INNER):
        raise ChunkError(f"unknown chunk kind {data[0]}")
    level, at = (0, 1) if data[0] == LEAF else (data[1] if len(data) > 1 else 0, 2)

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise ChunkError("a chunk ends early")
        at += n
        return data[at - n : at]

    def number() -> int:
        return int.from_bytes(take(4), "little")

    entries = []
    for _ in range(number()):
        key = take(number())
        entries.append((key, take(number()) if data[0] == LEAF else take(32)))
    if at != len(data):
        raise ChunkError("bytes after a chunk's end")
    if any(a[0] >= b[0] for a, b in pairwise(entries)):
        raise ChunkError("keys of a chunk don't rise")
    return level, entries


def chunk_address(payload: bytes) -> bytes:
    return hashlib.sha256(payload).digest()


class PairCodec:
    """The leaf codec of sorted pairs, and what any leaf codec must keep to.

    A codec is an injective `encode` of distinct entries with `decode` as its inverse; the
    fingerprint of a chunk is the XOR of its entries' digests and so the same under every codec.
    """

    TAG = LEAF

    @staticmethod
    def canonical(entries: list[tuple[bytes, bytes]]) -> list[tuple[bytes, bytes]]:
        out = sorted(entries)
        if any(a[0] == b[0] for a, b in pairwise(out)):
            raise ChunkError("a key occurs twice")
        return out

    @classmethod
    def encode(cls, entries: list[tuple[bytes, bytes]]) -> bytes:
        return encode_chunk(0, cls.canonical(entries))

    @staticmethod
    def decode(payload: bytes) -> list[tuple[bytes, bytes]]:
        level, entries = decode_chunk(payload)
        if level:
            raise ChunkError("not a leaf")
        return entries

    @classmethod
    def boundary_key(cls, payload: bytes) -> bytes:
        """The least key."""
        entries = cls.decode(payload)
        if not entries:
            raise ChunkError("an empty chunk")
        return entries[0][0]


def entries_fingerprint(entries: list[tuple[bytes, bytes]]) -> bytes:
    out = 0
    for k, v in entries:
        out ^= int.from_bytes(hashlib.sha256(encode_chunk(0, [(k, v)])).digest(), "big")
    return out.to_bytes(32, "big")


# boundaries


def next_boundaries(flags: np.ndarray) -> np.ndarray:
    """For a boundary after entry i the entry after which the next one is; len(flags) if none is left."""
    n = len(flags)
    candidates = flags.nonzero()[0]
    base = np.arange(n)
    i = np.searchsorted(candidates, base + MIN_ENTRIES)
    following = candidates[np.minimum(i, len(candidates) - 1)] if len(candidates) else np.full(n, n)
    found = (i < len(candidates)) & (following <= base + MAX_ENTRIES)
    return np.minimum(np.where(found, following, base + MAX_ENTRIES), n)


def first_boundary(flags: np.ndarray, since: int) -> int:
    """The first boundary where `since` entries precede the partition since the last one."""
    candidates = flags[: MAX_ENTRIES].nonzero()[0]
    candidates = candidates[candidates + since + 1 >= MIN_ENTRIES]
    forced = MAX_ENTRIES - since - 1
    return min(int(candidates[0]) if len(candidates) else len(flags), forced, len(flags))


def passages(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every number of entries since the last boundary: that number at the end, and the boundaries between."""
    n, after = len(flags), next_boundaries(flags).tolist()
    left, many = np.empty(MAX_ENTRIES, np.int64), np.empty(MAX_ENTRIES, np.int64)
    known: dict[int, tuple[int, int]] = {}  # boundary: (last boundary, boundaries from here on)
    for since in range(MAX_ENTRIES):
        at = first_boundary(flags, since)
        if at >= n:
            left[since], many[since] = since + n, 0
            continue
        path = []
        while at not in known and at < n:
            path.append(at)
            at = after[at]
        end, count = known.get(at, (path[-1] if path else -1, 0))
        for i, b in enumerate(reversed(path)):
            known[b] = (end, count + i + 1)
        end, count = known[path[0]] if path else known[at]
        left[since], many[since] = n - 1 - end, count
    return left, many


def _cuts(flags: np.ndarray, since: int) -> list[int]:
    after, at, out = next_boundaries(flags).tolist(), first_boundary(flags, since), []
    while at < len(flags):
        out.append(at)
        at = after[at]
    return out


# trees


def _by_part(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """A sorted batch in slices of one range partition each."""
    parts = batch.column("_part").to_numpy(zero_copy_only=False)
    edges = [0, *((np.diff(parts).nonzero()[0] + 1).tolist()), len(parts)]
    for a, b in pairwise(edges):
        if a < b:
            yield int(parts[a]), batch.slice(a, b - a)


def _entry_lists(column: pa.ListArray) -> Iterator[list[tuple[bytes, bytes]]]:
    """The entries of each chunk in turn; of one chunk at a time there are objects."""
    for x in column:
        yield list(zip(x.values.field(0).to_pylist(), x.values.field(1).to_pylist()))


def _entry_column(keys: list[bytes], values: list[bytes], sizes: list[int]) -> pa.ListArray:
    rows = pa.StructArray.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["key", "value"])
    return pa.ListArray.from_arrays(pa.array([0, *np.cumsum(sizes)], pa.int32()), rows)


@dataclass
class _Cutter:
    """Cuts the sorted entries of one task and holds no more than an open chunk and `SENT_ENTRIES` entries to send.

    `entry` and `before` tell for each range partition how many entries precede it since the last
    boundary and how many chunks end before it.
    """

    level: int
    width: int
    entry: dict[int, int]
    before: dict[int, int]
    alone: bool

    def __post_init__(self):
        self.keys, self.values, self.rows = [], [], []

    def pieces(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of chunks; `whole` ones have all entries of theirs and so an address."""
        part, start = None, 0
        for batch in batches:
            for now, rows in _by_part(batch):
                if now != part:
                    self._end(part, start, self.alone)
                    if len(self.keys) >= SENT_ENTRIES:
                        yield self._sent()
                    part, since, number, whole = now, self.entry[now], self.before[now], self.alone or self.entry[now] == 0
                    start = len(self.keys)
                keys, values, done = rows.column("key").to_pylist(), rows.column("value").to_pylist(), 0
                ends = _cuts(boundary_keys(keys, self.width), since)
                for end in ends:
                    self.keys += keys[done : end + 1]
                    self.values += values[done : end + 1]
                    self._note(part, number, start, whole)
                    number, whole, done = number + 1, True, end + 1
                    if len(self.keys) >= SENT_ENTRIES:
                        yield self._sent()
                    start = len(self.keys)
                since = len(keys) - 1 - ends[-1] if ends else since + len(keys)
                self.keys += keys[done:]
                self.values += values[done:]
                self.number = number
        self._end(part, start, self.alone)
        if self.rows:
            yield self._sent()

    def _end(self, part: int | None, start: int, whole: bool) -> None:
        """A partition's last entries, whose chunk may go on in the next one."""
        if part is not None and start < len(self.keys):
            self._note(part, self.number, start, whole)

    def _note(self, part: int, number: int, start: int, whole: bool) -> None:
        addr = chunk_address(encode_chunk(self.level, list(zip(self.keys[start:], self.values[start:])))) if whole else None
        self.rows.append((number, part, whole, self.keys[start], addr, len(self.keys) - start))

    def _sent(self) -> pa.RecordBatch:
        number, part, whole, first, addr, sizes = zip(*self.rows)
        out = pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int64()), pa.array(part, pa.int32()), pa.array(whole), pa.array([self.level] * len(first), pa.int32()), pa.array(first, pa.binary()), pa.array(addr, pa.binary()), _entry_column(self.keys, self.values, sizes)],
            ["chunk", "part", "whole", "level", "first", "addr", "entries"],
        )
        self.keys, self.values, self.rows = [], [], []
        return out


def _level(rows: DataFrame, n: int, level: int, width: int) -> DataFrame:
    """Chunks (level, first, addr, entries) of n rows (key, value), written.

    Workers read sorted rows as a stream and hold no partition whole.
    """
    parts = max(1, -(-n // PART_ENTRIES))
    if parts == 1:
        dealt, entry, before = rows.withColumn("_part", F.lit(0)).repartition(1).sortWithinPartitions("key"), {0: 0}, {0: 0}
    else:
        ranged = rows.repartitionByRange(parts, "key").withColumn("_part", F.spark_partition_id())
        ranged = materialize(ranged, "chunks-ranged")

        def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, flags = None, []

            def told() -> pa.RecordBatch:
                left, many = passages(np.concatenate(flags))
                return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([left.tolist()], pa.list_(pa.int64())), pa.array([many.tolist()], pa.list_(pa.int64()))], ["part", "left", "many"])

            for batch in batches:
                for now, keys in _by_part(batch):
                    if now != part and flags:
                        yield told()
                        flags = []
                    part = now
                    flags.append(boundary_keys(keys.column("key").to_pylist(), width))
            if flags:
                yield told()

        found = ranged.select("_part", "key").repartition("_part").sortWithinPartitions("_part", "key").mapInArrow(tables, "part int, left array<long>, many array<long>").collect()  # one row a partition
        entry, before, since, total = {}, {}, 0, 0
        for row in sorted(found, key=lambda r: r.part):
            entry[row.part], before[row.part] = since, total
            total += row.many[since]
            since = row.left[since]
        dealt = ranged.repartition("_part").sortWithinPartitions("_part", "key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _Cutter(level, width, entry, before, parts == 1).pieces(batches)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, first, addr = batch.column("entries"), [], []
            for entries in _entry_lists(column):
                first.append(entries[0][0])
                addr.append(chunk_address(encode_chunk(level, entries)))
            yield pa.RecordBatch.from_arrays([pa.array([level] * len(first), pa.int32()), pa.array(first, pa.binary()), pa.array(addr, pa.binary()), column], ["level", "first", "addr", "entries"])

    names = ["level", "first", "addr", "entries"]
    pieces = materialize(dealt.select("_part", "key", "value").mapInArrow(cut, f"chunk long, part int, whole boolean, level int, first binary, addr binary, entries {ENTRIES}"), "chunks-pieces")
    if parts == 1:
        return pieces.select(*names)
    discard(ranged)
    # What crosses partitions: at most two pieces of each, of chunks of `MAX_ENTRIES` entries.
    across = pieces.where("not whole").groupBy("chunk").agg(F.array_sort(F.flatten(F.collect_list("entries"))).alias("entries"))
    across = materialize(across.select("entries").mapInArrow(finish, f"level int, first binary, addr binary, entries {ENTRIES}"), "chunks-across")
    return pieces.where("whole").select(*names).unionByName(across)


@dataclass(frozen=True)
class Tree:
    root: bytes | None
    chunks: DataFrame
    height: int = 0


def build_tree(pairs: DataFrame, width: int = WIDTH) -> Tree:
    """The tree over distinct binary keys and values (key, value); no pairs give no root."""
    rows, level, out = pairs.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value")), 0, None
    n = rows.count()
    while True:
        chunks = _level(rows, n, level, width)
        out = chunks if out is None else out.unionByName(chunks)
        n = chunks.count()
        if n <= 1:
            return Tree(bytes(chunks.first()["addr"]) if n else None, out, level)
        rows, level = chunks.select(F.col("first").alias("key"), F.col("addr").alias("value")), level + 1


def _children(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("entries").alias("x")).select(F.col("x.value").alias("addr")).distinct()


def read_tree(store: DataFrame, root: bytes | None) -> DataFrame:
    """(key, value) of all leaves below a root, found level by level in a chunk table."""
    store = store.dropDuplicates(["addr"])
    top = store.where(F.col("addr") == F.lit(root)).select("level").head() if root else None
    if top is None:
        return store.limit(0).select(F.lit(None).cast("binary").alias("key"), F.lit(None).cast("binary").alias("value"))
    here = store.where(F.col("addr") == F.lit(root))
    for level in range(top["level"] - 1, -1, -1):
        here = store.where(F.col("level") == level).join(_children(here), "addr", "left_semi")
    return here.select(F.explode("entries").alias("x")).select("x.key", "x.value")


def diff_trees(left: Tree, right: Tree) -> DataFrame:
    """(key, kind) of entries that differ, found by descent.

    From the roots down only chunks whose address the other side's level lacks are opened, so
    equal subtrees are never read; entries of the leaves left over cancel where they are equal.
    """
    from .setops import keyed_diff

    sides = [t.chunks.where(F.col("level") == t.height).where(F.col("addr") == F.lit(t.root)) if t.root else t.chunks.limit(0) for t in (left, right)]
    if left.root == right.root:
        return left.chunks.limit(0).select(F.lit(None).cast("binary").alias("key"), F.lit(None).cast("string").alias("kind"))
    for level in range(max(left.height, right.height), 0, -1):
        now = []
        for i, t in enumerate((left, right)):
            if level > t.height:
                now.append(sides[i])
                continue
            other = (left, right)[1 - i]
            mine = sides[i].join(sides[1 - i].select("addr"), "addr", "left_anti") if level <= other.height else sides[i]
            now.append(t.chunks.where(F.col("level") == level - 1).join(_children(mine), "addr", "left_semi"))
        sides = [materialize(x, "chunks-front") for x in now] if level > 1 else now
    a, b = sides
    only = a.join(b.select("addr"), "addr", "left_anti"), b.join(a.select("addr"), "addr", "left_anti")
    return keyed_diff(*[x.select(F.explode("entries").alias("x")).select("x.key", "x.value") for x in only])


def transfer(source: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks to append, one row: transferred, skipped): copies only what the target lacks."""
    mine = source.dropDuplicates(["addr"])
    missing = mine.join(target.select("addr").distinct(), "addr", "left_anti")
    counts = mine.join(target.select("addr", F.lit(1).alias("_h")).distinct(), "addr", "left").agg(F.count(F.when(F.col("_h").isNull(), 1)).alias("transferred"), F.count("_h").alias("skipped"))
    return missing.select(*source.columns), counts


class ChunkTable:
    """A store of chunks by address: put, get, has, all and delete; putting a chunk again changes nothing."""

    def __init__(self, spark: SparkSession, chunks: DataFrame | None = None):
        self.spark = spark
        self.chunks = chunks if chunks is not None else spark.createDataFrame([], f"level int, first binary, addr binary, entries {ENTRIES}")

    def put(self, chunks: DataFrame) -> ChunkTable:
        missing, _ = transfer(chunks.select(*self.chunks.columns), self.chunks)
        return ChunkTable(self.spark, materialize(self.chunks.unionByName(missing), "chunks-table"))

    def get(self, addrs: DataFrame) -> DataFrame:
        """The chunks with these addresses (addr); each one's address is recomputed from its entries."""

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for level, addr, entries in zip(batch.column("level").to_pylist(), batch.column("addr").to_pylist(), _entry_lists(batch.column("entries"))):
                    if chunk_address(encode_chunk(level, entries)) != addr:
                        raise CorruptionError("a chunk's content isn't that of its address")
                yield batch

        return self.chunks.join(addrs.select("addr").distinct(), "addr", "left_semi").select(*self.chunks.columns).mapInArrow(check, self.chunks.schema)

    def has(self, addrs: DataFrame) -> DataFrame:
        """(addr, present) for each of the addresses (addr)."""
        known = self.chunks.select("addr", F.lit(True).alias("_in")).distinct()
        return addrs.select("addr").join(known, "addr", "left").select("addr", F.coalesce("_in", F.lit(False)).alias("present"))

    def all(self) -> DataFrame:
        return self.chunks.select("addr")

    def delete(self, addrs: DataFrame) -> ChunkTable:
        kept = materialize(self.chunks.join(addrs.select("addr").distinct(), "addr", "left_anti").select(*self.chunks.columns), "chunks-table")
        discard(self.chunks)
        return ChunkTable(self.spark, kept)


def manifest(roots: dict[str, bytes]) -> bytes:
    """Five tree roots in their fixed order, 160 bytes."""
    return b"".join(roots.get(k) or bytes(32) for k in KINDS)


def parse_manifest(data: bytes) -> dict[str, bytes]:
    if len(data) != 160:
        raise CorruptionError("a manifest has 160 bytes")
    return {k: data[i * 32 : i * 32 + 32] for i, k in enumerate(KINDS)}


def inclusion_proof(tree: Tree, key: bytes) -> list[tuple[int, bytes, list]]:
    """Chunks from the leaf that holds a key up to the root; a light client recomputes their addresses."""
    out = []
    for level in range(0, tree.height + 1 if tree.root else 0):
        row = tree.chunks.where((F.col("level") == level) & (F.col("first") <= F.lit(key))).orderBy(F.desc("first")).limit(1).collect()
        if not row:
            return []
        out.append((level, bytes(row[0]["addr"]), [(bytes(e["key"]), bytes(e["value"])) for e in row[0]["entries"]]))
    return out if out and key in [k for k, _ in out[0][2]] else []


def check_proof(proof: list[tuple[int, bytes, list]], root: bytes, key: bytes, value: bytes) -> bool:
    """Whether a proof shows that the tree with this root holds an entry."""
    want, addr = (key, value), None
    for level, _, entries in proof:
        if want not in entries:
            return False
        addr = chunk_address(encode_chunk(level, entries))
        want = (entries[0][0], addr)
    return addr == root


def commitment(tree: Tree) -> tuple[bytes | None, int]:
    """What a node publishes of its knowledge: the root alone and the number of levels; proofs open it key by key."""
    return tree.root, tree.height + (tree.root is not None)
