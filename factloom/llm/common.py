"""Shared plumbing of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..scratch import materialize, scratch_dir  # noqa: F401

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = "[^\\x20\\x09-\\x0D]+"

#: Largest table, by the bytes of its values, that is handed to every executor.
BROADCAST_BYTES = 16 << 20

#: Rows of a batch of texts that Python gets at a time.
BATCH_ROWS = 2000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands Python batches of at most `rows` rows.

    Spark's 10,000 whole texts are held by the JVM, outside its heap and doubled as they grow, and
    by the worker at the same time, in every task. The setting is read when a frame is run, so it stays.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def nested(docs: DataFrame, **columns: Column) -> DataFrame:
    """`docs` with each whole row in one struct column `row`, beside the columns named.

    The names of the rows' own columns can't clash with those that an operator adds.
    """
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(name) for name, c in columns.items()])


def unnested(rows: DataFrame, docs: DataFrame, new: dict[str, Column] | None = None) -> DataFrame:
    """The columns of `docs` out of `row`, those in `new` replaced or, if `docs` has no such, added."""
    new = new or {}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *[x.alias(c) for c, x in new.items() if c not in docs.columns])


def pieces(batch: pa.RecordBatch, column: int, rows: int = 500, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most `rows` rows and about `size` bytes of a text column; a longer text is alone."""
    texts = batch.column(column)
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, side="right"))), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` (a materialised table) with a broadcast hint if its values have at most `limit` bytes."""

    def size(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + 16
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.octet_length(F.to_json(F.struct(c))) + 16
        return F.lit(16)

    total = df.agg(F.sum(sum((size(f) for f in df.schema.fields[1:]), size(df.schema.fields[0])))).first()[0]
    return F.broadcast(df) if (total or 0) <= limit else df


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Cuts a stream sorted by `keys` into tables that hold whole runs of equal keys.

    Only the last, perhaps unfinished run is carried from batch to batch.
    """
    carry: list[pa.Table] = []
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        if carry:
            table = pa.concat_tables([*carry, table])
        cols = [table.column(k).to_numpy() for k in keys]
        changed = np.zeros(table.num_rows, bool)
        for c in cols:
            changed[1:] |= c[1:] != c[:-1]
        cut = int(changed.nonzero()[0][-1]) if changed.any() else 0
        if cut:
            yield table.slice(0, cut).combine_chunks()
        carry = [table.slice(cut)]
    if carry:
        yield pa.concat_tables(carry).combine_chunks()


def run_lengths(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal keys."""
    n = table.num_rows
    changed = np.ones(n, bool)
    if n > 1:
        changed[1:] = False
        for k in keys:
            c = table.column(k).to_numpy()
            changed[1:] |= c[1:] != c[:-1]
    starts = changed.nonzero()[0]
    return starts, np.diff(np.append(starts, n))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n items the smallest item it is connected to by the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if np.array_equal(before, label) and len(a):
            raise AssertionError("links don't settle")
    return label


def block_pairs(rows: DataFrame, hot: DataFrame, block: int, key: str = "key", node: str = "node") -> DataFrame:
    """Deals the rows of buckets into groups (key, lo, hi) of about 2 * `block` rows at most.

    `hot` holds (key, n) of the buckets with more than `block` rows. Such a bucket's rows fall
    into ceil(n / block) blocks by their hash, and every two blocks meet in one group, so that
    no pair of the bucket is lost and no task gets the whole bucket.
    """
    out = rows.join(hot, key, "left").withColumn("_parts", F.ceil(F.coalesce(F.col("n"), F.lit(1)) / block).cast("int"))
    out = out.withColumn("_own", F.pmod(F.xxhash64(node), F.col("_parts")).cast("int"))
    out = out.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return out.select(
        *rows.columns,
        F.least("_own", "_other").alias("lo"),
        F.greatest("_own", "_other").alias("hi"),
        F.col("_own").alias("own"),
    )


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the rows whose vector is not null, zero or empty and has finite components only."""
    x = F.col("v")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = table.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"))
    return rows.where(x.isNotNull() & F.coalesce(fine, F.lit(False)) & F.exists(x, lambda c: c != 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column whose lists are equally long, as a double matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
