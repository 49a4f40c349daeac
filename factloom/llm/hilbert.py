"""Operator 9: approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once for each curve with its own random projection
and shift, and ordered along the Hilbert curve of the projected grid. Spark range-partitions
every curve's order and cuts it into windows of `window` rows; a query is compared with the rows
of its own window and the neighbouring ones on every curve, the candidates merge, and the best
by exact distance stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import key_runs, materialize, matrix, read_table, run_lengths, usable_vectors

SEED = 9
#: Rows looked at to fit the projections and the grid's range.
FIT_ROWS = 20_000


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of `cells` (n by dims, values below 2 ** bits).

    Follows J. Skilling, Programming the Hilbert curve (2004): undo the excess rotations from
    the highest bit down, Gray-code, and interleave the bits.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            set_ = (x[i] & q) != 0
            t = np.where(set_, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(set_, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


class Curves:
    """The curves' projections, shifts and grids; fitted on a bounded sample of rows."""

    def __init__(self, sample: np.ndarray, curves: int, dims: int, bits: int):
        rng = np.random.default_rng([SEED, sample.shape[1]])
        dims = min(dims, sample.shape[1])
        self.scale = int(np.frexp(np.abs(sample).max(initial=0))[1])  # any power of two; keeps projections in range
        sample = np.ldexp(sample, -self.scale)
        self.bits, self.axes, self.shift, self.low, self.step = bits, [], [], [], []
        for _ in range(curves):
            axes = np.linalg.qr(rng.standard_normal((sample.shape[1], dims)))[0]
            y = sample @ axes
            spread = np.maximum(y.std(axis=0), 1e-12) * 8  # four deviations to each side, and a shift of up to half of one
            self.axes.append(axes)
            self.low.append(y.mean(axis=0) - spread / 2)
            self.step.append(2**bits / spread)
            self.shift.append(rng.uniform(-0.5, 0.5, dims) * 2**bits / 8)

    def keys(self, x: np.ndarray) -> np.ndarray:
        """The curve places of every row (n by curves)."""
        out, x = [], np.ldexp(x, -self.scale)
        for axes, low, step, shift in zip(self.axes, self.low, self.step, self.shift):
            cells = np.clip(np.nan_to_num((x @ axes - low) * step + shift), 0, 2**self.bits - 1)
            out.append(hilbert_index(cells.astype(np.int64), self.bits))
        return np.stack(out, axis=1)


def _best(queries: np.ndarray, rows: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query the rows no farther than its k-th nearest, with exact distances."""
    most = max(np.abs(queries).max(initial=0), np.abs(rows).max(initial=0))
    if most > 2.0**400 or 0 < most < 2.0**-400:  # squares leave the doubles' range: row by row, scaled where needed
        for i, q in enumerate(queries):
            gap = rows - q
            far = np.abs(gap).max(axis=1, initial=0)
            odd = (far > 2.0**400) | ((far > 0) & (far < 2.0**-400))
            by = np.where(odd, far, 1.0)
            dist = np.sqrt(((gap / by[:, None]) ** 2).sum(axis=1)) * by
            edge = np.partition(dist, k - 1)[k - 1] if len(rows) > k else np.inf
            near = (dist <= edge).nonzero()[0]
            yield i, near, dist[near]
        return
    norms = (rows**2).sum(axis=1)
    for at in range(0, len(queries), 256):
        q = queries[at : at + 256]
        rough = norms - 2 * q @ rows.T
        slack = 1e-9 * (np.abs(norms).max(initial=0) + (q**2).sum(axis=1) + 1e-300)
        edge = np.partition(rough, k - 1, axis=1)[:, k - 1] if len(rows) > k else np.full(len(q), np.inf)
        for i in range(len(q)):
            near = (rough[i] <= edge[i] + slack[i]).nonzero()[0]
            yield at + i, near, np.sqrt(((rows[near] - q[i]) ** 2).sum(axis=1))


def search_plan(gaps: np.ndarray, recall: float, windows: int) -> tuple[int, int]:
    """(curves, radius) that hold a share `recall` of the pairs with the fewest windows looked at.

    gaps has for each pair of a probe and a true neighbour the windows between them on every
    curve. A curve's windows are all rows, so no plan costs more than looking at each row once.
    """
    best = (windows, 1, windows)
    at = min(len(gaps) - 1, math.ceil(recall * len(gaps)) - 1)
    for used in range(1, gaps.shape[1] + 1):
        radius = int(np.sort(gaps[:, :used].min(axis=1))[at])
        best = min(best, (used * min(2 * radius + 1, windows), used, radius))
    return best[1], best[2]


def nearest_neighbours(
    table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, recall: float = 0.96, curves: int = 16, dims: int = 8, bits: int = 7, block: int = 512, probes: int = 200
) -> DataFrame:
    """(query_id, rank, id, score): for each row of `queries` its k nearest rows of `table` found.

    score is the Euclidean distance in double precision on the original vectors; nearest first,
    ties to the smaller id. A query is no candidate of its own id. Equal vectors are indexed once
    with their k + 1 smallest ids. Every usable row is indexed; projections and grid are fitted
    on `FIT_ROWS` rows. How many curves, and windows of `block` rows on each, a query looks at is
    measured: `probes` queries are answered by brute force over all rows, and of the plans that
    hold a share `recall` of their true neighbours the one with the fewest windows is taken, at
    most those of one curve. Vectors that are null, zero, empty or hold null or
    non-finite components take no part, nor do those of another length than most, nor null ids.
    """
    spark = table.sparkSession
    good = usable_vectors(table, id_col, vector_col).where("id is not null")
    lengths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()  # one row
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score double")
    if not lengths:
        return empty
    d = lengths[0]["d"]
    good = good.where(F.size("v") == d)
    asked = usable_vectors(queries, id_col, vector_col).where((F.col("id").isNotNull()) & (F.size("v") == d)).distinct()
    # One node for each different vector of table and queries; those of queries alone have no ids.
    order = Window.partitionBy("v").orderBy("id")
    some = good.distinct().withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k + 1).drop("_rn")
    some = some.withColumn("q", F.lit(False)).unionByName(asked.select(F.lit(None).cast("bigint").alias("id"), "v", F.lit(True).alias("q")).distinct())
    reps = some.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.max("q").alias("q"))
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("node"), "v", "ids", F.try_element_at("ids", F.lit(1)).alias("first"), "q"), "ann-reps")
    n = reps.count()
    kind = reps.schema["v"].dataType.simpleString()
    fit = reps.orderBy(F.xxhash64("v"), "first").limit(FIT_ROWS).select("v").toArrow()
    index = spark.sparkContext.broadcast(Curves(matrix(fit.column("v")), curves, dims, bits))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys = index.value.keys(matrix(part.column("v")))
                many = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
                curve = np.tile(np.arange(keys.shape[1], dtype=np.int32), part.num_rows)
                yield pa.RecordBatch.from_arrays([pa.array(curve), pa.array(keys.ravel()), *(part.column(c).take(many) for c in ("node", "first", "q", "v"))], ["curve", "key", "node", "first", "q", "v"])

    rows = reps.select("node", "first", "q", "v").mapInArrow(placed, f"curve int, key long, node long, first long, q boolean, v {kind}")
    rows = rows.repartitionByRange("curve", "key", "node").sortWithinPartitions("curve", "key", "node")
    rows = materialize(rows.withColumn("_mono", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_mono", 33)), "ann-order")
    parts = rows.groupBy("_part").agg(F.count("*").alias("c")).orderBy("_part").collect()  # one row a partition
    before = np.concatenate([[0], np.cumsum([p["c"] for p in parts])])
    offsets = spark.createDataFrame([(int(p["_part"]), int(b)) for p, b in zip(parts, before)], "_part long, _offset long")
    place = (F.col("_offset") + F.col("_mono").bitwiseAND((1 << 33) - 1)) % n
    rows = rows.join(F.broadcast(offsets), "_part").select("curve", "node", "first", "q", "v", F.floor(place / block).cast("int").alias("win"))  # bounded: a row a partition
    last = (n - 1) // block

    # How many curves and how wide, measured.
    probe = reps.where("q").orderBy(F.xxhash64("v"), "first").limit(probes).select("node", F.col("v").alias("qv")).toArrow()  # bounded
    used, radius = 1, last + 1
    if probe.num_rows and last > 0:
        pq, pnode = spark.sparkContext.broadcast(matrix(probe.column("qv"))), probe.column("node").to_pylist()

        def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    for i, near, dist in _best(pq.value, matrix(batch.column("v")), k + 1):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), i, np.int32)), batch.column("node").take(pa.array(near)), pa.array(dist)], ["i", "node", "dist"])

        top = reps.where("first is not null").select("node", "v").mapInArrow(brute, "i int, node long, dist double")
        top = top.withColumn("_r", F.row_number().over(Window.partitionBy("i").orderBy("dist", "node"))).where(F.col("_r") <= k + 1)
        own = spark.createDataFrame([(i, x) for i, x in enumerate(pnode)], "i int, own long")
        pairs = F.broadcast(top.select("i", "node").join(F.broadcast(own), "i").where("node <> own"))  # bounded by probes * k
        wins = rows.select("curve", "node", "win")
        here = wins.join(pairs, "node").select("i", "node", "own", "curve", "win")
        there = wins.join(F.broadcast(own.select(F.col("own").alias("_o")).distinct()), wins.node == F.col("_o")).select("_o", F.col("curve").alias("_c"), F.col("win").alias("_w"))
        gaps = here.join(there, (here.own == there._o) & (here.curve == there._c)).select("i", "node", "curve", F.abs(F.col("win") - F.col("_w")).alias("gap"))
        gaps = gaps.groupBy("i", "node").agg(F.array_sort(F.collect_list(F.struct("curve", "gap"))).alias("g")).select("g").collect()  # bounded by probes * k
        if gaps:
            used, radius = search_plan(np.array([[x["gap"] for x in g["g"]] for g in gaps]), recall, last + 1)

    # Neighbouring windows: every query goes to those around its own place on each curve in use.
    rows = rows.where(F.col("curve") < used)
    spots = rows.where("q").select("curve", F.explode(F.sequence(F.greatest(F.col("win") - radius, F.lit(0)), F.least(F.col("win") + radius, F.lit(last)))).alias("win"), "node", F.lit(None).cast("bigint").alias("first"), "v", F.lit(True).alias("q"))
    both = spots.unionByName(rows.where("first is not null").select("curve", "win", "node", "first", "v", F.lit(False).alias("q")))
    both = both.repartition("curve", "win").sortWithinPartitions("curve", "win", "q", "node")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["curve", "win"]
        for table in key_runs(batches, keys):
            for start, length in zip(*run_lengths(table, keys)):
                run = table.slice(start, length)
                is_q = run.column("q").to_numpy(zero_copy_only=False)
                m = int((~is_q).sum())
                if m in (0, length):
                    continue
                x, ids, first = matrix(run.column("v")), run.column("node").to_numpy(), run.column("first")[:m].to_numpy()
                qs, ns, ds = [], [], []
                for i, near, dist in _best(x[m:], x[:m], k + 1):
                    order = np.lexsort((first[near], dist))[: k + 1]
                    qs.append(np.full(len(order), ids[m + i]))
                    ns.append(ids[near[order]])
                    ds.append(dist[order])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (qs, ns, ds)], ["_q", "node", "score"])

    found = both.mapInArrow(scan, "_q long, node long, score double").groupBy("_q", "node").agg(F.min("score").alias("score"))
    found = found.join(reps.select("node", "first", "ids"), "node")
    best = Window.partitionBy("_q").orderBy("score", "first")
    found = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).select("_q", "score", F.explode("ids").alias("id"))
    best = Window.partitionBy("_q").orderBy("score", "id")
    found = materialize(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1).drop("_r"), "ann-found")
    # Each query gets its vector's answer without itself.
    mine = materialize(asked.select(F.col("id").alias("query_id"), "v").join(reps.select("v", F.col("node").alias("_q")), "v").select("query_id", "_q"), "ann-asked")
    ranked = mine.join(found, "_q").where("id <> query_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "id", "score")


def op9_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    found = nearest_neighbours(table, table.where("vec_id % 100 = 0"))
    return found.withColumnRenamed("id", "vec_id")
