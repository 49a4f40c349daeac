"""Operator 4: removal of byte strings that occur anywhere else, by suffix arrays of shards.

A string of `length` bytes holds length - gram + 1 grams; the least of their hashes names the
string, so equal strings have one name wherever they start. Neighbouring strings mostly share
their name, and a document splits into segments, the maximal runs of starts with one name. A
name that only one segment of the corpus has can hold no repeat but in itself. Equal segments are
told by their digest. Where different segments share a name, they are put together in shards, and
a shard's suffix array (induced sorting) with its permuted common prefixes tells which strings
repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import discard
from .common import key_runs, materialize, pieces, read_table, run_lengths
from .suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 400, 32
#: Bytes of one shard's text, and of one name's segments beyond which they are named more finely.
SHARD, HOT = 1 << 20, 1 << 18
#: Words of a passage that another document repeats, and of the runs that tell it.
PASSAGE, RUN = 51, 32

_BYTE = np.random.default_rng(4).integers(0, 2**64, 256, np.uint64)
_MULT = 0x9E3779B97F4A7C15


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of `gram` bytes (a power of two)."""
    h, mult, width = _BYTE[data], _MULT, 1
    while width < gram:
        h = h[:-width] * np.uint64(mult) + h[width:]
        mult, width = mult * mult % 2**64, width * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bool]]:
    """(name, first start, starts, whether a string may repeat inside) of each segment."""
    if len(data) < length:
        return
    h = _gram_hashes(np.frombuffer(data, np.uint8), gram)
    window = length - gram + 1
    m = _least(h, window)
    cuts = np.concatenate([[0], (m[1:] != m[:-1]).nonzero()[0] + 1, [len(m)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        twice = b - a > window or np.count_nonzero(h[a : b + window - 1] == m[a]) > 1
        yield int(m[a].view(np.int64)), a, b - a, bool(twice)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLACE = np.random.default_rng(5).integers(0, 2**64, 64, np.uint64) | np.uint64(1)


def passage_marks(data: bytes, passage: int = PASSAGE, run: int = RUN) -> np.ndarray:
    """Hashes of runs of `run` words (a power of two) of which every passage of `passage` words holds one, the same wherever it is."""
    b = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[b]
    starts = (inside & ~np.concatenate([[False], inside[:-1]])).nonzero()[0]
    if len(starts) < passage:
        return np.empty(0, np.uint64)
    chars = inside.nonzero()[0]
    first = np.searchsorted(chars, starts)
    place = np.arange(len(chars)) - np.repeat(first, np.diff(np.append(first, len(chars))))
    h, mult, width = np.add.reduceat(_BYTE[b[chars]] * _PLACE[place & 63], first), _MULT, 1
    while width < run:
        h = h[:-width] * np.uint64(mult) + h[width:]
        mult, width = mult * mult % 2**64, width * 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(_least(h ^ (h >> np.uint64(29)), passage - run + 1))


def _least(h: np.ndarray, window: int) -> np.ndarray:
    """The minimum of every `window` neighbours."""
    width = 1
    while width * 2 <= window:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    return np.minimum(h[: len(h) - (window - width)], h[window - width :]) if width < window else h


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passage: int = PASSAGE, run: int = RUN) -> DataFrame:
    """(k, n_passages): documents, as hash of id and text, that share passages of `passage` words with others.

    n_passages counts the marks (`passage_marks`) that another document has too: one at least
    for a shared passage, and none for less than `run` shared words. White space may differ.
    """
    rows = _keyed(docs, id_col, text_col).select(_number().alias("k"), "t")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                found = [passage_marks(t.as_py().encode(), passage, run) for t in part.column(1)]
                many = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([part.column(0).take(many), pa.array(np.concatenate(found).view(np.int64))], ["k", "f"])

    marks = materialize(rows.mapInArrow(mark, "k long, f long"), "suffix-marks")
    shared = marks.groupBy("f").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low <> high").select("f")
    out = materialize(marks.join(shared, "f", "left_semi").groupBy("k").agg(F.count("*").alias("n_passages")), "suffix-passages")
    discard(marks)
    return out


def _number() -> Column:
    return F.xxhash64("d", "th")


def _ranges(flags: np.ndarray) -> list[list[int]]:
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.stack([(edge > 0).nonzero()[0], (edge < 0).nonzero()[0]], axis=1).tolist()


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text which starts of strings of `length` bytes also start elsewhere in the texts."""
    flat = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum([0] + [len(t) for t in texts])
    valid = np.zeros(len(flat), bool)
    for b, t in zip(begin, texts):
        valid[b : b + max(0, len(t) - length + 1)] = True
    sa = suffix_array(flat)
    lcp = permuted_lcp(flat, sa, length)[sa]
    group = np.cumsum(lcp < length)
    counts = np.bincount(group, weights=valid[sa])
    again = np.zeros(len(flat), bool)
    again[sa] = counts[group] >= 2
    again &= valid
    return [again[b : b + max(0, len(t) - length + 1)] for b, t in zip(begin, texts)]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("d"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("th"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d, th, spans): byte spans (from, to), perhaps overlapping, of repeated strings by document.

    d is the id and th a hash of the text; documents equal in both are counted as often as they
    occur.
    """
    rows = _keyed(docs, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.schema.get_field_index("t"), 200):
                owner, name, first, n, twice, digest = [], [], [], [], [], []
                for i, t in enumerate(part.column("t")):
                    data = t.as_py().encode()
                    for h, a, k, x in segments(data, length, gram):
                        owner.append(i)
                        name.append(h)
                        first.append(a)
                        n.append(k)
                        twice.append(x)
                        digest.append(xxhash.xxh3_128_digest(data[a : a + k + length - 1]))
                if owner:
                    many = pa.array(owner)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(name, pa.int64()), pa.array(digest, pa.binary()), part.column("d").take(many), part.column("th").take(many), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(twice)],
                        ["h", "g", "d", "th", "s", "n", "twice"],
                    )

    found = materialize(rows.mapInArrow(cut, f"h long, g binary, d {kind}, th long, s int, n int, twice boolean"), "suffix-segments")
    shared = found.groupBy("h").agg(F.count("*").alias("c"), F.max("twice").alias("x")).where("c > 1 or x").select("h")
    live = materialize(found.join(shared, "h", "left_semi"), "suffix-live")
    # Distinct segments, each with how often it occurs and where one of its occurrences is.
    place = F.min(F.struct("d", "th", "s")).alias("at")
    discard(found)
    distinct = materialize(live.groupBy("h", "g", "n").agg(F.count("*").alias("c"), F.max("twice").alias("twice"), place), "suffix-distinct")
    names = distinct.groupBy("h").agg(F.count("*").alias("k"), F.sum(F.col("n").cast("bigint") + length - 1).alias("size"), F.max("twice").alias("x"), F.min("c").alias("least"))
    names = materialize(names.where("least = 1 and (k > 1 or x)").select("h", (F.col("size") > HOT).alias("hot")), "suffix-names")
    mixed = distinct.join(names, "h")

    # The texts of the segments to compare, cut from their documents.
    wanted = mixed.groupBy("at.d", "at.th").agg(F.collect_list(F.struct("h", "g", "at.s", "n", "hot")).alias("cuts"))
    cut_from = rows.join(wanted.withColumnsRenamed({"d": "_d", "th": "_th"}), F.col("d").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th"))).select("t", "cuts")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, cuts in zip(batch.column("t"), batch.column("cuts")):
                data, own = t.as_py().encode(), cuts.as_py()
                x = [data[c["s"] : c["s"] + c["n"] + length - 1] for c in own]
                yield pa.RecordBatch.from_arrays([pa.array([c["h"] for c in own], pa.int64()), pa.array([c["g"] for c in own], pa.binary()), pa.array([c["hot"] for c in own]), pa.array(x, pa.binary())], ["h", "g", "hot", "x"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shard(hs: list[int], gs: list[bytes], bs: list[bytes]) -> pa.RecordBatch:
            flags = repeated_starts(bs, length)
            return pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(gs, pa.binary()), pa.array([_ranges(f) for f in flags], pa.list_(pa.list_(pa.int32())))], ["h", "g", "r"])

        hs, gs, bs, size = [], [], [], 0
        for table in key_runs(batches, ["h"]):
            for start, n in zip(*run_lengths(table, ["h"])):
                run = table.slice(start, n)
                seen = {}  # documents equal in id and text give their segments more than once
                for h, g, b in zip(run.column("h").to_pylist(), run.column("g").to_pylist(), run.column("x").to_pylist()):
                    seen[g] = (h, b)
                more = sum(len(b) for _, b in seen.values())
                if size and size + more > SHARD:
                    yield shard(hs, gs, bs)
                    hs, gs, bs, size = [], [], [], 0
                for g, (h, b) in seen.items():
                    hs.append(h)
                    gs.append(g)
                    bs.append(b)
                size += more
        if size:
            yield shard(hs, gs, bs)


    pieces_ = materialize(cut_from.mapInArrow(pick, "h long, g binary, hot boolean, x binary"), "suffix-pieces")
    cold = pieces_.where("not hot").select("h", "g", "x").repartition("h").sortWithinPartitions("h", "g")
    cold = cold.mapInArrow(compare, "h long, g binary, r array<array<int>>").where("size(r) > 0")
    hot = _hot_ranges(pieces_.where("hot").select("h", "g", "x"), length, gram)
    often = distinct.where("c > 1").select("h", "g", F.array(F.array(F.lit(0), F.col("n"))).alias("r"))
    ranges = often.unionByName(cold.unionByName(hot).join(often.select("h", "g"), ["h", "g"], "left_anti"))
    ranges = materialize(ranges, "suffix-ranges")
    discard(pieces_, distinct, names)
    hits = live.select("h", "g", "d", "th", "s").join(ranges, ["h", "g"])
    spans = F.transform("r", lambda x: F.struct((F.col("s") + x[0]).alias("a"), (F.col("s") + x[1] + length - 1).alias("b")))
    hits = materialize(hits.select("d", "th", spans.alias("x")), "suffix-hits")
    return hits.groupBy("d", "th").agg(F.array_distinct(F.flatten(F.collect_list("x"))).alias("spans"))


#: Neighbouring starts that a hot name's segments are told by at once.
BLOCK = 16


def blocks(data: bytes, length: int, gram: int) -> Iterator[tuple[int, bytes, bytes, int, int]]:
    """(block, core digest, digest, first, last start) of runs of up to BLOCK starts of a segment.

    Starts are dealt by their distance to the least gram that their string holds, so equal
    strings are in equal blocks. The core is what all strings of a block have in common.
    """
    h = _gram_hashes(np.frombuffer(data, np.uint8), gram)
    starts = np.arange(len(data) - length + 1)
    least = (h == h.min()).nonzero()[0]
    anchor = least[np.searchsorted(least, starts)]
    block = (anchor - starts) // BLOCK
    cuts = np.concatenate([[0], ((block[1:] != block[:-1]) | (anchor[1:] != anchor[:-1])).nonzero()[0] + 1, [len(starts)]])
    for lo, hi in zip(cuts[:-1].tolist(), (cuts[1:] - 1).tolist()):
        a, q = int(anchor[lo]), int(block[lo])
        core = xxhash.xxh3_128_digest(data[a - BLOCK * q : a - BLOCK * q - BLOCK + 1 + length])
        yield q, core, xxhash.xxh3_128_digest(b"%d:%d:" % (a - lo, a - hi) + data[lo : hi + length]), lo, hi


def _hot_ranges(segs: DataFrame, length: int, gram: int) -> DataFrame:
    """(h, g, r): ranges of repeated starts in different segments (h, g, x) that share a hot name.

    Blocks equal as a whole repeat as a whole; blocks with a core of their own don't repeat.
    Only of blocks that share their core and differ every string's digest is compared, one for
    each different block, so what all documents have in common is told once.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = [(i, *b) for i, x in enumerate(part.column("x")) for b in blocks(x.as_py(), length, gram)]
                i, *cols = zip(*rows)
                many = pa.array(i)
                kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("h").take(many), part.column("g").take(many), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["h", "g", "q", "core", "full", "lo", "hi"])

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, g, x, runs in zip(batch.column("h"), batch.column("g"), batch.column("x"), batch.column("runs")):
                data = x.as_py()
                i = [k for r in runs.as_py() for k in range(r["lo"], r["hi"] + 1)]
                w = [xxhash.xxh3_128_digest(data[k : k + length]) for k in i]
                yield pa.RecordBatch.from_arrays([pa.array([h.as_py()] * len(i), pa.int64()), pa.array([g.as_py()] * len(i), pa.binary()), pa.array(i, pa.int32()), pa.array(w, pa.binary())], ["h", "g", "i", "w"])

    dealt = materialize(segs.mapInArrow(deal, "h long, g binary, q int, core binary, full binary, lo int, hi int"), "suffix-blocks")
    fulls = dealt.groupBy("h", "q", "core", "full").agg(F.count("*").alias("c"), F.min(F.struct("g", "lo", "hi")).alias("one"))
    fulls = materialize(fulls, "suffix-fulls")
    whole = dealt.join(fulls.where("c > 1").select("h", "q", "core", "full"), ["h", "q", "core", "full"], "left_semi").select("h", "g", F.struct("lo", (F.col("hi") + 1).alias("to")).alias("r"))
    mixed = materialize(fulls.groupBy("h", "q", "core").agg(F.count("*").alias("k")).where("k > 1").drop("k"), "suffix-cores")
    runs = fulls.join(mixed, ["h", "q", "core"], "left_semi").groupBy("h", "one.g").agg(F.collect_list(F.struct("one.lo", "one.hi")).alias("runs"))
    windows = materialize(segs.join(runs, ["h", "g"]).mapInArrow(strings, "h long, g binary, i int, w binary"), "suffix-windows")
    again = materialize(windows.groupBy("h", "w").agg(F.count("*").alias("c")).where("c > 1").select("h", "w"), "suffix-again")
    single = windows.join(again, ["h", "w"], "left_semi").select("h", "g", F.struct(F.col("i").alias("lo"), (F.col("i") + 1).alias("to")).alias("r"))
    found = whole.unionByName(single).groupBy("h", "g").agg(F.collect_list("r").alias("r"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rs in batch.column("r").to_pylist():
                own: list[list[int]] = []
                for lo, to in sorted((r["lo"], r["to"]) for r in rs):
                    if own and lo <= own[-1][1]:
                        own[-1][1] = max(own[-1][1], to)
                    else:
                        own.append([lo, to])
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("g"), pa.array(out, pa.list_(pa.list_(pa.int32())))], ["h", "g", "r"])

    return found.mapInArrow(joined, "h long, g binary, r array<array<int>>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, texts: bool = False, passages: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row, with `texts` also kept (binary), with `passages` n_passages.

    Every byte covered by a string of `length` bytes that starts anywhere else too goes, all
    occurrences alike; overlaps count and matches stay within documents. A null text is empty.
    Rows that repeat an id, or id and text, are documents of their own. Texts shorter than
    `length` stay whole. n_passages tells of shared passages of many words, which may be shorter
    than `length` (`repeated_passages`); it removes nothing.
    """
    spans = repeated_spans(docs, id_col, text_col, length, gram).withColumn("k", _number()).withColumnsRenamed({"d": "_d", "th": "_th"})
    if passages:
        spans = spans.join(repeated_passages(docs, id_col, text_col), "k", "full_outer")
    else:
        spans = spans.withColumn("n_passages", F.lit(0).cast("bigint"))
    spans = spans.withColumnRenamed("k", "_k")
    rows = _keyed(docs, id_col, text_col)
    own = F.col("_th").isNull() | (F.col("d").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_th")))
    rows = rows.join(spans, (_number() == F.col("_k")) & own, "left").select("d", "t", "spans", F.coalesce("n_passages", F.lit(0)).alias("n_passages"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, batch.schema.get_field_index("t")):
                out = []
                for t, found in zip(part.column("t"), part.column("spans")):
                    data, kept, n, end = t.as_py().encode(), [], 0, 0
                    begin = None
                    for x in sorted((x["a"], x["b"]) for x in found.as_py() or []):
                        if begin is None or x[0] > end:
                            kept.append(data[end if begin is not None else 0 : x[0]])
                            n += 1
                            begin, end = x
                        else:
                            end = max(end, x[1])
                    kept = b"".join([*kept, data[end:]])
                    out.append((len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept))
                cols = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                more = [part.column("n_passages")] if passages else []
                yield pa.RecordBatch.from_arrays([part.column("d"), *cols[: 4 + texts], *more], [f.name for f in schema])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType())])
    if texts:
        schema = schema.add("kept", T.BinaryType())
    if passages:
        schema = schema.add("n_passages", T.LongType())
    return rows.mapInArrow(finish, schema)


def op4_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"), passages=True)
