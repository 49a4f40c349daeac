"""Operator 5: mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every document of a source is wanted target / source size times. The whole copies of that are
certain. For the rest, documents are ranked by their random odds divided by their inclusion
odds, and taken in that order until the source's remaining words are used up. The cut in the
ranking is found by two rounds of histograms, so a source of any size is summed in parts before
its shuffle and only the few documents around the cut are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, maybe_broadcast, read_table

BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size, target): weighted shares of all words, none above cap * source_size.

    The excess of capped sources goes to the others by weight until none is above. With the
    sources in order of cap / weight that is one level for the uncapped, the largest of the
    levels that the prefixes of the order imply.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows without a partition: one row a source, not a document.
    ranked = by_source.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("_i", F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_i")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("_total", F.sum("source_size").over(every).cast("double"))
    ranked = ranked.withColumn("_before", F.coalesce(F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    ranked = ranked.withColumn("_open", F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("_level", F.max((F.col("_total") - F.col("_before")) / F.col("_open")).over(every))
    return ranked.select("source", "source_size", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))


def _cut(rows: DataFrame, bucket: str, already: str) -> DataFrame:
    """For each source the bucket in which its remaining words run out, and the words before it."""
    sums = rows.groupBy("src", "rest", already, bucket).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("src").orderBy(bucket)
    sums = sums.withColumn("before", F.col(already) + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = sums.where((F.col("before") <= F.col("rest")) & (F.col("before") + F.col("words") > F.col("rest")))
    return at.select(F.col("src").alias("s"), F.col(bucket).alias(f"{bucket}_cut"), F.col("before").alias(f"{bucket}_before"))


class _Mix:
    """What a mix is decided by: a row a source, and the few groups of rows around the cuts.

    `sizes` has every row (id, src, size, th, odds), `sources` for each source its whole copies
    and its cut, `close` the rows in the buckets of the cuts, grouped by (src, rank, id, size, th)
    with their number m and how many of them, k, get one copy more.
    """

    def __init__(self, rows: DataFrame, weights: Sequence[float], cap: float):
        self.sizes = materialize(rows, "mix-sizes")
        targets = source_targets(self.sizes.select(F.col("src").alias("source"), "size"), weights, cap)
        f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
        targets = targets.select(F.col("source").alias("s"), "source_size", "target", F.floor(f).cast("int").alias("copies"), (f - F.floor(f)).alias("pi"))
        targets = targets.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("zero", F.lit(0).cast("bigint"))
        targets = materialize(targets, "mix-targets")
        self.sources = maybe_broadcast(targets)
        # Sources whose copies are all whole have nothing to rank.
        ranked = self.ranked(self.sizes).where("pi > 0").select("src", "id", "size", "th", "rank", "b1", "b2", "rest", "zero")
        first = materialize(_cut(ranked, "b1", "zero"), "mix-cut1")
        inside = ranked.join(maybe_broadcast(first), F.col("src").eqNullSafe(F.col("s")) & (F.col("b1") == F.col("b1_cut"))).drop("s")
        second = materialize(_cut(inside, "b2", "b1_before"), "mix-cut2")
        edge = inside.join(maybe_broadcast(second), F.col("src").eqNullSafe(F.col("s")) & (F.col("b2") == F.col("b2_cut")))
        groups = edge.groupBy("src", "rank", "id", "size", "th", "rest", "b2_before").agg(F.count("*").alias("m"))
        order = Window.partitionBy("src").orderBy("rank", "id", "size", "th").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("rest") - F.col("b2_before") - F.coalesce(F.sum(F.col("size") * F.col("m")).over(order), F.lit(0))
        k = F.when(F.col("size") > 0, F.floor((left * 2 + F.col("size")) / (F.col("size") * 2))).otherwise(F.when(left >= 0, F.col("m")).otherwise(0))
        groups = groups.withColumn("k", F.greatest(F.lit(0), F.least(k, F.col("m"))).cast("bigint"))
        self.close = materialize(groups.select("src", "id", "size", "th", "m", "k"), "mix-close")
        cuts = first.select(F.col("s").alias("s1"), "b1_cut").join(second.select(F.col("s").alias("s2"), "b2_cut"), F.col("s1").eqNullSafe(F.col("s2")), "left").drop("s2")
        self.sources = maybe_broadcast(materialize(targets.join(cuts, F.col("s").eqNullSafe(F.col("s1")), "left").drop("s1"), "mix-sources"))

    def ranked(self, rows: DataFrame) -> DataFrame:
        """`rows` (src, odds and more) with their source's columns, rank and buckets."""
        rows = rows.join(self.sources, F.col("src").eqNullSafe(F.col("s"))).drop("s")
        pareto = F.col("odds") / (F.col("pi") / (1 - F.col("pi")))
        rows = rows.withColumn("rank", F.when(F.col("pi") > 0, pareto / (1 + pareto)))
        rows = rows.withColumn("b1", F.least(F.floor(F.col("rank") * BUCKETS), F.lit(BUCKETS - 1)))
        return rows.withColumn("b2", F.floor((F.col("rank") * BUCKETS - F.col("b1")) * BUCKETS))

    def decided(self, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(rows off the cuts with `extra`, rows in a cut's bucket)."""
        rows = self.ranked(rows)
        cut = F.coalesce((F.col("b1") == F.col("b1_cut")) & (F.col("b2") == F.col("b2_cut")), F.lit(False))
        before = F.coalesce((F.col("b1") < F.col("b1_cut")) | ((F.col("b1") == F.col("b1_cut")) & (F.col("b2") < F.col("b2_cut"))), F.lit(False))
        return rows.where(~cut).withColumn("extra", before.cast("int")), rows.where(cut)


def _odds(id_: Column, seed: str, propensity: Column | None) -> Column:
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))
    return u / (1 - u) if propensity is None else u / (1 - u) / propensity


def _rows(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str, propensity: Column | None) -> tuple[Column, ...]:
    text = F.col(text_col)
    return F.col(id_col).alias("id"), F.col(source_col).alias("src"), word_count(text).alias("size"), F.xxhash64(text).alias("th"), _odds(F.col(id_col), seed, propensity).alias("odds")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", propensity: Column | None = None
) -> DataFrame:
    """(id, size, source, source_size, target, taken, copies) of every row.

    size counts white-space words (a null text has 0); sources are ordered by code point, null
    last as one source of its own, and take `weights` in turn. taken is a whole number of copies
    of the document, floor or ceiling of target / source_size, so never over `cap` copies;
    a source's taken words differ from its target by half of one document at most. `propensity`
    scales a document's inclusion odds. Ranks come from a hash of `seed` and the id, so
    reruns agree; rows that repeat an id are equals in the ranking, by size and text, and rows
    equal in all of that are counted and not sorted. A source at its cap takes whole copies only
    and ranks nothing. Empty sources and empty tables give no words.
    """
    mix = _Mix(docs.select(*_rows(docs, id_col, text_col, source_col, seed, propensity)), weights, cap)
    far, _ = mix.decided(mix.sizes)
    # Rows of a group are equal in every column that is returned, so the group stands for them.
    close = mix.close.join(mix.sources, F.col("src").eqNullSafe(F.col("s"))).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
    close = close.withColumn("extra", (F.col("i") <= F.col("k")).cast("int"))
    names = ["id", "size", "src", "source_size", "target", "copies", "extra"]
    out = far.select(*names).unionByName(close.select(*names)).withColumn("n", F.col("copies") + F.col("extra"))
    return out.select(F.col("id").alias(id_col), "size", F.col("src").alias("source"), "source_size", "target", (F.col("size") * F.col("n")).cast("bigint").alias("taken"), F.col("n").cast("int").alias("copies"))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (1, 2, 3), cap: float = 3.0, seed: str = "mix", propensity: Column | None = None
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it; columns are those of `docs`.

    Texts are not shuffled: a row's copies follow from its id, its source's row and, around the
    cuts, a small table. Rows equal in id, source and text are equals; where a cut falls among
    them they are numbered, partition by partition, and the first take one copy more.
    """
    how = (id_col, text_col, source_col, seed, propensity)
    mix = _Mix(docs.select(*_rows(docs, *how)), weights, cap)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    id_, src, size, th, odds = _rows(docs, *how)
    far, near = mix.decided(docs.select(whole, id_, src, odds, size, th))
    close = maybe_broadcast(mix.close.select(*[F.col(c).alias(f"c_{c}") for c in mix.close.columns]))
    same = F.col("src").eqNullSafe(F.col("c_src")) & F.col("id").eqNullSafe(F.col("c_id")) & F.col("th").eqNullSafe(F.col("c_th")) & (F.col("size") == F.col("c_size"))
    near = near.join(close, same).withColumn("extra", (F.col("c_k") == F.col("c_m")).cast("int"))
    split = (F.col("c_k") > 0) & (F.col("c_k") < F.col("c_m"))
    # At most one group of equal rows a source is split by its cut.
    torn = materialize(near.where(split).select("row", "copies", "src", "c_k", F.monotonically_increasing_id().alias("mono")), "mix-torn")
    torn = torn.withColumn("part", F.shiftright("mono", 33))
    parts = torn.groupBy("src", "part").agg(F.count("*").alias("n"))  # a row a partition and source
    parts = parts.select(F.col("src").alias("p_src"), F.col("part").alias("p_part"), F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"))
    torn = torn.join(F.broadcast(parts), F.col("src").eqNullSafe(F.col("p_src")) & (F.col("part") == F.col("p_part")))
    inside = F.row_number().over(Window.partitionBy("src", "part").orderBy("mono"))
    torn = torn.withColumn("extra", (F.col("n_before") + inside <= F.col("c_k")).cast("int"))
    names = ["row", "copies", "extra"]
    out = far.select(*names).unionByName(near.where(~split).select(*names)).unionByName(torn.select(*names)).withColumn("n", F.col("copies") + F.col("extra"))
    out = out.where("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::DOUBLE AS wt, source_size * 3.0::DOUBLE AS cap FROM s),
l AS (SELECT a.*, (SELECT max(((SELECT sum(source_size) FROM w)::DOUBLE
                    - coalesce((SELECT sum(y.cap) FROM w y WHERE y.cap / y.wt < x.cap / x.wt), 0))
                   / (SELECT sum(y.wt) FROM w y WHERE y.cap / y.wt >= x.cap / x.wt)) FROM w x) AS level FROM w a),
t AS (SELECT source, source_size, least(cap, level * wt) AS target FROM l),
r AS (SELECT d.*, t.source_size, t.target, floor(t.target / t.source_size) AS copies,
             t.target / t.source_size - floor(t.target / t.source_size) AS pi
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) ELSE 1e300 END AS rk FROM r),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rk, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM q)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN upto * 2 - size <= (target - copies * source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
