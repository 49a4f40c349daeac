"""Index-ordered scans, point gets, positions and run structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialize
from ..types import EAVT, ID_COLS, ORDERS, TX_COLS, ValidationError


def scan(datoms: DataFrame, order: str = "eavt") -> DataFrame:
    """All facts in one of the four orders; the sort is a range exchange."""
    return datoms.orderBy(*ORDERS[order])


def point_get(datoms: DataFrame, **key) -> DataFrame:
    """The facts with these column values; on sorted files the scan skips by their statistics."""
    out = datoms
    for name, value in key.items():
        out = out.where(F.col(name).eqNullSafe(value if isinstance(value, Column) else F.lit(value)))
    return out


def contains(datoms: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of `wanted` that are facts of `datoms`, compared on the whole identity."""
    on = [F.col(f"w.{c}").eqNullSafe(F.col(f"d.{c}")) for c in ID_COLS]
    return wanted.alias("w").join(datoms.alias("d"), on, "left_semi")


def entity_exists(datoms: DataFrame, entities: DataFrame) -> DataFrame:
    """(e, present) for each of the entities (e)."""
    known = datoms.select("e").distinct().withColumn("_in", F.lit(True))
    return entities.join(known, "e", "left").select("e", F.coalesce("_in", F.lit(False)).alias("present"))


#: Rows of one window in which rows are compared with those before them.
ORDER_BLOCK = 1 << 16


def from_sorted(datoms: DataFrame, order: list[str] | None = None) -> DataFrame:
    """`datoms`, which must lie in strictly rising order, with their rank `pos`; the facts returned are not sorted or shuffled.

    The order is that of the frame's partitions and of the rows inside each. It is checked in blocks of
    `ORDER_BLOCK` rows, whose last row is looked at in the next block too, and between partitions, where
    only borders are compared; rows out of order or repeated raise.
    """
    order = order or EAVT
    rows = datoms.withColumn("_id", F.monotonically_increasing_id())
    rows = materialize(rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "scan-presorted")
    block = F.floor(F.col("_at") / ORDER_BLOCK)
    blocks = F.when((F.col("_at") + 1) % ORDER_BLOCK == 0, F.array(block, block + 1)).otherwise(F.array(block))
    keyed = rows.select("_part", "_at", F.struct(*order).alias("_key"))
    falls = F.lag("_key").over(Window.partitionBy("_part", "_block").orderBy("_at")) >= F.col("_key")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition, as is what follows
    ends = keyed.join(F.broadcast(counts), "_part").where((F.col("_at") == 0) | (F.col("_at") == F.col("_n") - 1))
    borders = ends.groupBy("_part").agg(F.min_by("_key", "_at").alias("_low"), F.max_by("_key", "_at").alias("_high"))
    apart = borders.withColumn("_bad", F.lag("_high").over(Window.orderBy("_part")) >= F.col("_low")).where("_bad")
    if not keyed.withColumn("_block", F.explode(blocks)).select(falls.alias("_bad")).where("_bad").isEmpty() or not apart.isEmpty():
        raise ValidationError("facts are not in strictly rising order")
    return rows.join(before_each(counts, "_part", "_n"), "_part").select(*datoms.columns, (F.col("_at") + F.col("_n")).alias("pos"))


def unique_entities(datoms: DataFrame) -> DataFrame:
    return datoms.select("e").distinct()


def before_each(rows: DataFrame, number: str = "_part", *sums: str) -> DataFrame:
    """(number, sums): for each partition the totals of the partitions before, of a table with a row a partition.

    The window without a partition sees a row for each partition of the data, never the data.
    """
    w = Window.orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(rows.select(number, *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(c) for c in sums]))


def ordered(datoms: DataFrame, order: list[str], partitions: int | None = None) -> DataFrame:
    """`datoms` range-partitioned and sorted, with `_part` and the place `_at` inside it; written once.

    What follows counts and joins the same partitions, whatever is recomputed.
    """
    ranged = datoms.repartitionByRange(partitions, *order) if partitions else datoms.repartitionByRange(*order)
    ranged = ranged.sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(ranged.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id"), "scan-ordered")


def positions(datoms: DataFrame, order: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """`datoms` with their rank `pos` in a sort order, from 0.

    Rows are range-partitioned and counted by partition; a row's rank is its rank in its partition
    plus the rows of the partitions before, so no task sees all rows.
    """
    ranged = ordered(datoms, order or EAVT, partitions)
    before = before_each(ranged.groupBy("_part").agg(F.count("*").alias("_n")), "_part", "_n")
    return ranged.join(before, "_part").select(*datoms.columns, (F.col("_at") + F.col("_n")).alias("pos"))


def permutation(datoms: DataFrame, order: str) -> DataFrame:
    """(rank, pos): for each rank in another order the rank in EAVT order."""
    return positions(positions(datoms).withColumnRenamed("pos", "_pos"), ORDERS[order]).select(F.col("pos").alias("rank"), F.col("_pos").alias("pos"))


def tx_permutation(datoms: DataFrame) -> DataFrame:
    """(rank, pos) in order of transactions, then positions."""
    return positions(positions(datoms).withColumnRenamed("pos", "_pos"), [*TX_COLS, "_pos"]).select(F.col("pos").alias("rank"), F.col("_pos").alias("pos"))


def entity_runs(datoms: DataFrame) -> DataFrame:
    """(e, run, first, length): runs of equal entities in EAVT order with their first position."""
    runs = ordered(datoms.groupBy("e").agg(F.count("*").alias("length")), ["e"])
    before = before_each(runs.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("length").alias("_sum")), "_part", "_n", "_sum")
    inside = F.coalesce(F.sum("length").over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = runs.withColumn("_inside", inside).join(before, "_part")
    return out.select("e", (F.col("_at") + F.col("_n")).alias("run"), (F.col("_inside") + F.col("_sum")).alias("first"), "length")


def run_of(runs: DataFrame, placed: DataFrame) -> DataFrame:
    """(pos, run, e) of every fact of `placed` (e, pos): which run a position is in; runs are by entity, so this is a join on it."""
    return placed.select("e", "pos").join(runs.select("e", "run"), "e").select("pos", "run", "e")


def run_range(runs: DataFrame, run: int) -> DataFrame:
    """One row (e, start, stop): the entity of a run and its positions, end exclusive."""
    return runs.where(F.col("run") == run).select("e", F.col("first").alias("start"), (F.col("first") + F.col("length")).alias("stop"))


def entity_at(runs: DataFrame, pos: int) -> DataFrame:
    """One row (run, e) for the position; none beyond the last."""
    return runs.where((F.col("first") <= pos) & (F.lit(pos) < F.col("first") + F.col("length"))).select("run", "e")


def run_counts(runs: DataFrame) -> DataFrame:
    """One row: n_runs and n_facts."""
    return runs.agg(F.count("*").alias("n_runs"), F.coalesce(F.sum("length"), F.lit(0)).alias("n_facts"))


#: Positions of one block of a prefix sum.
RANK_BLOCK = 1 << 16


def _ranked(placed: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """`placed` and `rank`: how many rows with the flag come before, for each value of `keys`.

    Rows are counted by block of positions and key; blocks' counts are summed by blocks of blocks,
    and so no window holds more than `RANK_BLOCK` rows, nor all of a frequent key's.
    """
    block = lambda c, n: F.floor(F.col(c) / n)
    rows = placed.withColumn("_f", F.when(flag, 1).otherwise(0)).withColumn("_b", block("pos", RANK_BLOCK))
    up = Window.unboundedPreceding, -1
    inside = F.coalesce(F.sum("_f").over(Window.partitionBy("_b", *keys).orderBy("pos").rowsBetween(*up)), F.lit(0))
    sums = rows.groupBy("_b", *keys).agg(F.sum("_f").alias("_n")).withColumn("_c", block("_b", RANK_BLOCK))
    high = sums.groupBy("_c", *keys).agg(F.sum("_n").alias("_m"))  # a row for 2 ** 32 positions and key
    high = high.select("_c", *keys, F.coalesce(F.sum("_m").over((Window.partitionBy(*keys) if keys else Window).orderBy("_c").rowsBetween(*up)), F.lit(0)).alias("_m"))
    low = F.coalesce(F.sum("_n").over(Window.partitionBy("_c", *keys).orderBy("_b").rowsBetween(*up)), F.lit(0))
    before = sums.select("_b", "_c", *keys, low.alias("_low")).join(high, ["_c", *keys]).select("_b", *keys, (F.col("_low") + F.col("_m")).alias("_before"))
    out = rows.withColumn("_inside", inside).join(before, ["_b", *keys])
    return out.select(*placed.columns, (F.col("_inside") + F.col("_before")).alias("rank"))


def rank1(placed: DataFrame, flag: Column) -> DataFrame:
    """`placed` (with pos) and `rank`, how many rows before it have the flag set."""
    return _ranked(placed, [], flag)


def select1(placed: DataFrame, flag: Column, k: int) -> DataFrame:
    """The row with the k-th set flag, from 0."""
    return rank1(placed, flag).where(flag & (F.col("rank") == k)).drop("rank")


def symbol_rank(placed: DataFrame, column: str) -> DataFrame:
    """`placed` and `rank`, how many earlier rows have the same symbol: the wavelet rank."""
    return _ranked(placed, [column], F.lit(True))


def symbol_select(placed: DataFrame, column: str, symbol, k: int) -> DataFrame:
    """One row (pos): where a symbol's k-th occurrence is, from 0; none if there are fewer."""
    return symbol_rank(placed.where(F.col(column) == F.lit(symbol)), column).where(F.col("rank") == k).select("pos")


def symbol_access(placed: DataFrame, column: str, positions_: DataFrame) -> DataFrame:
    """(pos, symbol) at the positions (pos)."""
    return placed.select("pos", F.col(column).alias("symbol")).join(positions_.select("pos").distinct(), "pos", "left_semi")


def attribute_dim(datoms: DataFrame) -> DataFrame:
    """(attr_id, a): attributes numbered in name order."""
    return positions(datoms.select("a").distinct(), ["a"]).select(F.col("pos").cast("int").alias("attr_id"), "a")


def resolve_attributes(dim: DataFrame, ids: DataFrame) -> DataFrame:
    """(attr_id, a) of the ids (attr_id); null names for ids that the dictionary lacks."""
    return ids.select("attr_id").join(dim, "attr_id", "left")


def intern_attributes(dim: DataFrame, names: DataFrame) -> DataFrame:
    """The dictionary with the names (a) it lacks appended in name order; ids that are there stay."""
    new = names.select("a").distinct().join(dim, "a", "left_anti")
    top = dim.agg(F.coalesce(F.max("attr_id"), F.lit(-1)).alias("_top"))  # one row
    more = positions(new, ["a"]).crossJoin(F.broadcast(top)).select((F.col("pos") + F.col("_top") + 1).cast("int").alias("attr_id"), "a")
    return dim.select("attr_id", "a").unionByName(more)


def encoded(datoms: DataFrame, dim: DataFrame) -> DataFrame:
    """`datoms` with attr_id, null for attributes the dictionary lacks."""
    return datoms.join(dim, "a", "left")


def byte_histogram(datoms: DataFrame, column: str) -> DataFrame:
    """(byte, n) over a text or binary column."""
    digits = F.hex(F.col(column).cast("binary"))
    pairs = F.transform(F.sequence(F.lit(0), (F.length(digits) / 2).cast("int") - 1), lambda i: F.conv(F.substr(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("int"))
    return datoms.where(F.length(digits) > 0).select(F.explode(pairs).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


def entropy_ratio(histogram: DataFrame) -> DataFrame:
    """One row: bits per byte over 8, what an ideal entropy coder would leave."""
    total = histogram.agg(F.sum("n").alias("t"))
    p = F.col("n") / F.col("t")
    return histogram.crossJoin(F.broadcast(total)).agg((F.sum(-p * F.log2(p)) / 8).alias("ratio"))  # one row
