"""Operator 2: embedding near-duplicates by random-hyperplane hashing in several tables.

Each table hashes a vector to the signs of a few random projections; vectors that share a bucket
in some table are compared by exact cosine in double precision, and links are joined to
components. The number of signs grows with the logarithm of the row count, and the number of
tables is set by the recall wanted for a pair right at the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import block_pairs, key_runs, local_components, materialize, matrix, maybe_broadcast, read_table, run_lengths, usable_vectors
from .components import connected_components

SEED = 2
BLOCK = 512


def table_plan(rows: int, threshold: float, recall: float) -> tuple[int, int]:
    """(signs a table, tables) for so many vectors."""
    signs = min(24, max(6, math.ceil(math.log2(max(rows, 2) / 32))))
    agree = (1 - math.acos(threshold) / math.pi) ** signs
    return signs, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows whose squares leave the doubles' range, scaled by a power of two; the cosine stays."""
    most = np.abs(x).max(axis=1, initial=0)
    odd = (most > 2.0**400) | (most < 2.0**-400)
    if odd.any():
        x = x.copy()
        x[odd] = np.ldexp(x[odd], -np.frexp(most[odd])[1][:, None])
    return x


def most_bits(signs: int, tables: int, threshold: float) -> int:
    """Signs, over all tables, in which a pair at the threshold differs at most, six deviations included."""
    n, p = signs * tables, math.acos(threshold) / math.pi
    return math.ceil(n * p + 6 * math.sqrt(n * p * (1 - p)))


def link_vectors(reps: DataFrame, threshold: float, signs: int, tables: int, block: int = BLOCK) -> DataFrame:
    """(node, links, root) for the vectors of `reps` (node, mult, v) found within the threshold.

    Buckets are dealt out by signatures alone, and only vectors that have another of like
    signature in their bucket follow them there. links adds the multiplicities of linked
    vectors, each pair counted in the first table in which it meets; root connects the node to
    the smallest of its links in the bucket.
    """
    most = most_bits(signs, tables, threshold)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(signs, dtype=np.int64)
        for batch in batches:
            dims = batch.column("v").value_lengths().to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                d = int(d)
                if d not in planes:
                    planes[d] = np.random.default_rng([SEED, d]).standard_normal((d, tables * signs))
                for at in range(0, part.num_rows, 1000):
                    some = part.slice(at, 1000)
                    n = some.num_rows
                    sig = ((scaled(matrix(some.column("v"))) @ planes[d]) > 0).reshape(n, tables, signs) @ weights
                    key = sig + (np.arange(tables) << 24) + (d << 40)
                    all_ = pa.array([x.tobytes() for x in sig.astype(np.int32)], pa.binary())
                    many = pa.array(np.repeat(np.arange(n), tables))
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), some.column("node").take(many), all_.take(many)], ["key", "node", "sigs"])

    def keys_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in hashed(batches):
            yield batch.select(["key"])

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows that have another of like signature in their bucket."""
        keys = ["key", "lo", "hi"]
        for table in key_runs(batches, keys):
            keep = np.zeros(table.num_rows, bool)
            sigs = table.column("sigs").combine_chunks()
            for start, length in zip(*run_lengths(table, keys)):
                if length < 2:
                    continue
                sig = np.frombuffer(b"".join(sigs.slice(start, length).to_pylist()), np.int32).view(np.uint32).reshape(length, -1)
                for i in range(0, length, 64):
                    some = sig[i : i + 64]
                    differ = np.zeros((len(some), length), np.int32)
                    for t in range(tables):
                        differ += np.bitwise_count(some[:, t, None] ^ sig[None, :, t])
                    keep[start + i : start + i + len(some)] = (differ <= most).sum(axis=1) > 1  # more than itself
            live = keep.nonzero()[0]
            if len(live):
                yield from table.take(pa.array(live)).combine_chunks().to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["key", "lo", "hi"]
        for table in key_runs(batches, keys):
            for start, length in zip(*run_lengths(table, keys)):
                if length < 2:
                    continue
                run = table.slice(start, length)
                t = int(run.column("key")[0].as_py() >> 24) & 0xFFFF
                x = scaled(matrix(run.column("v")))
                unit = x / np.linalg.norm(x, axis=1)[:, None]
                own = run.column("own").to_numpy()
                i, j = np.nonzero(np.triu(unit @ unit.T >= threshold - 1e-9, 1))
                if run.column("lo")[0].as_py() != run.column("hi")[0].as_py():
                    i, j = i[own[i] != own[j]], j[own[i] != own[j]]
                if not len(i):
                    continue
                sig = np.frombuffer(b"".join(run.column("sigs").to_pylist()), np.int32).reshape(length, -1)
                links, mult, label = np.zeros(length, np.int64), run.column("mult").to_numpy(), np.arange(length)
                for at in range(0, len(i), 50_000):
                    a, b = i[at : at + 50_000], j[at : at + 50_000]
                    cos = (x[a] * x[b]).sum(axis=1) / (np.linalg.norm(x[a], axis=1) * np.linalg.norm(x[b], axis=1))
                    new = (cos >= threshold) & ~(sig[a, :t] == sig[b, :t]).any(axis=1)
                    a, b = a[new], b[new]
                    np.add.at(links, a, mult[b])
                    np.add.at(links, b, mult[a])
                    joined = (label != np.arange(length)).nonzero()[0]
                    label = local_components(length, np.concatenate([a, joined]), np.concatenate([b, label[joined]]))
                found = links.nonzero()[0]
                node = run.column("node").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(node[found]), pa.array(links[found]), pa.array(node[label[found]])], ["node", "links", "root"])

    counts = reps.select("node", "v").mapInArrow(keys_only, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = maybe_broadcast(materialize(counts, "cosine-hot"))
    rows = block_pairs(reps.select("node", "v").mapInArrow(hashed, "key long, node long, sigs binary"), hot, block)
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    live = materialize(rows.mapInArrow(alike, "key long, node long, sigs binary, lo int, hi int, own int"), "cosine-live")
    rows = live.join(reps, "node").select("key", "lo", "hi", "own", "node", "mult", "v", "sigs")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "node")
    return rows.mapInArrow(compare, "node long, links long, root long")


def embedding_neardup(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, recall: float = 0.9995, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Equal vectors are compared once and counted as often as they occur. Vectors of other lengths
    never link; null, zero and empty vectors and those with null or non-finite components link
    with nothing and are kept as their own component, as are rows with a null id. Links are pairs
    with cosine >= `threshold`; `recall` is the chance to find a pair right at the threshold,
    and closer pairs are likelier found.
    """
    good = usable_vectors(table, id_col, vector_col).where("id is not null")
    reps = materialize(good.groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("mult")), "cosine-reps")
    signs, tables = table_plan(reps.count(), threshold, recall)
    found = materialize(link_vectors(reps, threshold, signs, tables, block), "cosine-found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comps = connected_components(found.select(F.col("node").alias("src"), F.col("root").alias("dst")))
    groups = reps.join(links, "node", "left").join(comps, "node", "left")
    groups = materialize(groups.select("v", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")), "cosine-groups")
    rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))
    out = rows.join(groups, "v", "left")
    with_id = F.col("id").isNotNull()
    component = F.when(with_id, F.coalesce("component_id", "id")).cast("bigint")
    return out.select("id", F.when(with_id, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op2_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return embedding_neardup(read_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


OP2_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS norm
  FROM (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings)
  WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (
  SELECT a.vec_id AS s, b.vec_id AS t
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE CASE WHEN len(a.x) = len(b.x) THEN list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.95 END),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.t FROM r JOIN l ON r.t = l.s),
n AS (SELECT s, count(*) AS n FROM l GROUP BY s),
c AS (SELECT s, min(t) AS component_id FROM r GROUP BY s)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id::BIGINT AS component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.s = vec_id LEFT JOIN n ON n.s = vec_id
"""
