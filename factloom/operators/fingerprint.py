"""Homomorphic fingerprints, chunk fingerprints, and bottom-k sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codec import Hash, content_hash, hash256, hex_of
from .scans import positions

SLICES = [(1, 15), (16, 15), (31, 15), (46, 15), (61, 4)]
DEFAULT_CHUNK, DEFAULT_K = 1024, 256


def _xor(digest_hex: str) -> list[Column]:
    """XOR of 256-bit digests in five numbers; an associative aggregate, combined before shuffles."""
    return [F.coalesce(F.bit_xor(F.conv(F.substring(F.col(digest_hex), at, n), 16, 10).cast("bigint")), F.lit(0)).alias(f"_x{at}") for at, n in SLICES]


def _joined() -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(f"_x{at}"), n, "0") for at, n in SLICES]))


def fact_hashes(datoms: DataFrame, digest: Hash = hash256) -> DataFrame:
    return datoms.withColumn("_h", hex_of(content_hash(digest=digest)))


def fingerprint(datoms: DataFrame, digest: Hash = hash256) -> DataFrame:
    """One row: the XOR of all content hashes; zero for no facts. Facts must be distinct."""
    return fact_hashes(datoms, digest).agg(*_xor("_h")).select(_joined().alias("fingerprint"))


def chunk_fingerprints(datoms: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """(chunk, fingerprint, n) over runs of `chunk` positions in EAVT order."""
    rows = positions(fact_hashes(datoms)).withColumn("chunk", F.floor(F.col("pos") / chunk))
    return rows.groupBy("chunk").agg(*_xor("_h"), F.count("*").alias("n")).select("chunk", _joined().alias("fingerprint"), "n")


def store_fingerprint(chunks: DataFrame) -> DataFrame:
    """The fingerprint from the chunks' fingerprints; equals that of the facts."""
    return chunks.agg(*_xor("fingerprint")).select(_joined().alias("fingerprint"))


def insert_hashes(chunks: DataFrame, inserted: DataFrame, chunk: int = DEFAULT_CHUNK) -> DataFrame:
    """(chunk, fingerprint, n, dirty): chunk fingerprints after facts (pos, _h) were added; only those are hashed.

    XOR is its own inverse and combines in any order, so a chunk takes in its new facts' digests
    alone. Chunks that took any in are dirty; a position beyond the last chunk makes a new one.
    """
    kept = chunks.select("chunk", "fingerprint", "n", F.coalesce(F.col("dirty"), F.lit(False)).alias("dirty") if "dirty" in chunks.columns else F.lit(False).alias("dirty"))
    new = inserted.select(F.floor(F.col("pos") / chunk).alias("chunk"), F.col("_h").alias("fingerprint"), F.lit(1).cast("bigint").alias("n"), F.lit(True).alias("dirty"))
    return kept.unionByName(new).groupBy("chunk").agg(*_xor("fingerprint"), F.sum("n").alias("n"), F.max("dirty").alias("dirty")).select("chunk", _joined().alias("fingerprint"), "n", "dirty")


def mark_dirty(chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """`chunks` with `dirty` set for those of `touched` (chunk) too."""
    hit = touched.select("chunk").distinct().withColumn("_hit", F.lit(True))
    old = F.coalesce(F.col("dirty"), F.lit(False)) if "dirty" in chunks.columns else F.lit(False)
    return chunks.join(hit, "chunk", "left").withColumn("dirty", old | F.coalesce("_hit", F.lit(False))).drop("_hit")


def dirty_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where("dirty").select("chunk")


def clear_dirty(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("dirty", F.lit(False))


def diff_chunks(left: DataFrame, right: DataFrame) -> DataFrame:
    """Chunks whose fingerprints differ; a missing chunk counts as zero."""
    zero = "0" * 64
    a, b = left.select(F.col("chunk").alias("_a"), F.col("fingerprint").alias("_f")), right.select(F.col("chunk").alias("_b"), F.col("fingerprint").alias("_g"))
    both = a.join(b, a._a == b._b, "full_outer")
    return both.where(F.coalesce("_f", F.lit(zero)) != F.coalesce("_g", F.lit(zero))).select(F.coalesce("_a", "_b").alias("chunk"))


def sketch(datoms: DataFrame, k: int = DEFAULT_K) -> DataFrame:
    """One row (hashes, n, k): the k smallest content hashes, in order, and the number of facts.

    The top k of every partition meet in one task; the count is its own aggregate.
    """
    if k <= 0:
        raise ValueError("a sketch keeps one hash at least")
    rows = fact_hashes(datoms).select("_h")
    low = rows.orderBy("_h").limit(k).agg(F.array_sort(F.collect_list("_h")).alias("hashes"))
    return low.crossJoin(rows.agg(F.count("*").alias("n"))).withColumn("k", F.lit(k))  # one row each


def _pair(a: DataFrame, b: DataFrame) -> DataFrame:
    a, b = (x.select(*[F.col(c).alias(f"{p}_{c}") for c in ("hashes", "n", "k")]) for x, p in ((a, "l"), (b, "r")))
    checked = F.when(F.col("l_k") != F.col("r_k"), F.raise_error(F.lit("sketches of different sizes"))).otherwise(F.lit(True))
    both = a.crossJoin(b).where(checked)  # one row each
    common = F.size(F.array_intersect("l_hashes", "r_hashes"))
    return both.withColumns({"_i": common, "_u": F.size("l_hashes") + F.size("r_hashes") - common})


def jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: overlap of two sketches' signatures over their union; both empty 1, one empty 0."""
    return _pair(a, b).select(F.when(F.col("_u") == 0, 1.0).otherwise(F.col("_i") / F.col("_u")).alias("jaccard"))


def jaccard_unbiased(a: DataFrame, b: DataFrame) -> DataFrame:
    """Like jaccard, over the k smallest of the union only, which is the unbiased estimate."""
    low = F.slice(F.array_sort(F.array_union("l_hashes", "r_hashes")), 1, F.col("l_k"))
    both = _pair(a, b).withColumn("_low", low)
    hits = F.size(F.array_intersect(F.array_intersect("_low", "l_hashes"), "r_hashes"))
    return both.select(F.when(F.size("_low") == 0, 1.0).otherwise(hits / F.size("_low")).alias("jaccard"))


def estimated_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many facts the stores seem to differ by, rounded half up."""
    p = _pair(a, b)
    total, gap, base = F.col("l_n") + F.col("r_n"), F.col("_u") - F.col("_i"), F.col("_u") + F.col("_i")
    rounded = F.expr("((l_n + r_n) * (_u - _i) * 2 + (_u + _i)) div (2 * (_u + _i))")
    est = F.when((total == 0) | (gap == 0), F.lit(0)).when(F.col("l_n") == 0, F.col("r_n")).when(F.col("r_n") == 0, F.col("l_n")).when(base > 0, rounded)
    return p.select(est.cast("bigint").alias("estimated_difference"))


def merge_sketches(a: DataFrame, b: DataFrame) -> DataFrame:
    """The k smallest of both; counts add."""
    return _pair(a, b).select(F.slice(F.array_sort(F.array_union("l_hashes", "r_hashes")), 1, F.col("l_k")).alias("hashes"), (F.col("l_n") + F.col("r_n")).alias("n"), F.col("l_k").alias("k"))


def bijection_check(layouts: dict[str, DataFrame]) -> DataFrame:
    """(layout, n, fingerprint) of copies of one store in several orders; all rows must agree."""
    out = None
    for name, df in layouts.items():
        row = fact_hashes(df).agg(*_xor("_h"), F.count("*").alias("n")).select(F.lit(name).alias("layout"), "n", _joined().alias("fingerprint"))
        out = row if out is None else out.unionByName(row)
    return out
