"""Ordering building blocks: top-k per key, block-wise numbering and filling, exact percentiles.

A plain window over one key puts that key's rows into one task. The functions here keep the
work of a hot key spread out: top-k relies on the group limit Spark applies before the shuffle,
numbering and filling go through blocks whose totals are combined in a second, small step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.session import shared_folder


def top_per(
    df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """First n rows of every key; each map task passes on at most n rows per key."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def newest(df: DataFrame, keys: list[str], ts: str, tie: str, n: int) -> DataFrame:
    order = [F.col(ts).desc(), F.col(tie).desc()]
    if keys:
        return top_per(df, keys, order, n)
    return df.orderBy(*order).limit(n)


def number_rows(
    df: DataFrame, group: list[str], block: list[str], order: list[str], name: str, total: str | None = None
) -> DataFrame:
    """Number each group's rows from 0 in the order (block, order).

    `block` must not decrease along the order (a file split, an hour). Rows are numbered inside
    (group, block), so a group holding a large part of the table is still spread over its blocks;
    the block offsets come from one small table of block sizes.
    """
    inside = Window.partitionBy(*group, *block).orderBy(*order)
    sizes = df.groupBy(*group, *block).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("_size").over(Window.partitionBy(*group)).cast("int"))
    keys = [*group, *block]
    renamed = offsets.drop("_size").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], "_offset", *([total] if total else [])
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    numbered = df.withColumn("_local", F.row_number().over(inside))
    out = numbered.join(renamed, on).withColumn(
        name, (F.col("_local") + F.col("_offset") - 1).cast("int")
    )
    return out.drop("_local", "_offset", *[f"_k_{k}" for k in keys])


def in_slices(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` in even ranges along `order`, with `_slice`, which grows along it, and `_row`, the place in the slice from 0.

    Ranges are cut from a sample of the rows, so a hot key is spread over as many as its share of the rows, also where all its
    rows fall into one second; only rows equal in all of `order` stay together. Runs a job when called: the ranges are written
    to the shared folder once and read from there, so that everything made of them sees the same cuts.
    """
    path = shared_folder(df.sparkSession, "slices")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    rows = df.sparkSession.read.schema(ranged.schema).parquet(path)
    # The id is the partition's number above 33 bits of the row's place in it.
    return rows.select(
        *df.columns, F.shiftright("_place", 33).alias("_slice"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
    )


def number_in_order(df: DataFrame, group: list[str], order: list[str], name: str, total: str) -> DataFrame:
    """Number each group's rows from 0 along `order` and count them, whatever part of the table or the time a group holds.

    Rows are sorted in even ranges (`in_slices`); one small row per group and range gives what lies before it.
    """
    rows = in_slices(df, [*group, *order])
    per_group = Window.partitionBy(*group)
    before = per_group.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*group, "_slice").agg(F.min("_row").alias("_at"), F.count(F.lit(1)).alias("_size")).select(
        *[F.col(k).alias(f"_k_{k}") for k in group], F.col("_slice").alias("_s"),
        (F.coalesce(F.sum("_size").over(before), F.lit(0)) - F.col("_at")).alias("_shift"),
        F.sum("_size").over(per_group).cast("int").alias(total),
    )
    on = F.col("_slice") == F.col("_s")
    for k in group:
        on &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(parts, on).select(*df.columns, (F.col("_row") + F.col("_shift")).cast("int").alias(name), total)


def running_total(
    df: DataFrame, group: list[str], block: list[str], order: list[str], value: Column, name: str,
    of_group: dict[str, tuple[Column, Callable[[str], Column]]] | None = None,
) -> DataFrame:
    """Sum of `value` over the rows before each one in its group, block by block as in number_rows.

    `of_group` adds columns on whole groups, each by its aggregate of a block's rows and the function that merges blocks.
    """
    more = of_group or {}
    keys = [*group, *block]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), *[c.alias(n) for n, (c, _) in more.items()]).select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"),
        *[merge(n).over(Window.partitionBy(*group)).alias(n) for n, (_, merge) in more.items()],
    )
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    local = df.withColumn("_local", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return local.join(offsets, on).withColumn(name, F.col("_local") + F.col("_offset")).drop("_local", "_offset", *[f"_k_{k}" for k in keys])


def fill_forward(
    df: DataFrame, group: list[str], block: list[str], order: list[str], columns: list[str]
) -> DataFrame:
    """Replace nulls by the last earlier value of the group, block by block as in number_rows."""
    inside = Window.partitionBy(*group, *block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    position = F.struct(*[F.col(o) for o in order])
    ends = df.groupBy(*group, *block).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_e_{c}") for c in columns]
    )
    before = Window.partitionBy(*group).orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_k_{k}") for k in [*group, *block]],
        *[F.last_value(f"_e_{c}", True).over(before).alias(f"_c_{c}") for c in columns],
    )
    on = None
    for k in [*group, *block]:
        same = F.col(k).eqNullSafe(F.col(f"_k_{k}"))
        on = same if on is None else on & same
    local = df
    for c in columns:
        local = local.withColumn(f"_l_{c}", F.last_value(c, True).over(inside))
    joined = local.join(carried, on)
    for c in columns:
        joined = joined.withColumn(c, F.coalesce(f"_l_{c}", f"_c_{c}"))
    return joined.select(*df.columns)


def exact_percentile(df: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """Interpolated percentile per key without holding a key's values in one place.

    Values are counted per (key, bucket), where the bucket grows with the value; only the one or
    two buckets that hold the wanted positions are counted value by value and ranked.
    """
    v = F.col(value)
    # Equal steps of the logarithm on either side of zero, so no magnitude shares one bucket.
    size = F.lit(300_000) + F.floor(F.log2(F.abs(v)) * 256)
    bucket = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0))
    counted = (
        df.where(v.isNotNull())
        .select(*keys, v.alias("_v"), bucket.alias("_b"))
        .groupBy(*keys, "_b", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sizes = counted.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"))
    by_key = Window.partitionBy(*keys)
    spans = sizes.select(
        *keys,
        "_b",
        (F.sum("_bn").over(by_key.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_bn")).alias("_start"),
        F.col("_bn"),
        ((F.sum("_bn").over(by_key) - 1) * F.lit(float(q))).alias("_pos"),
    )
    lo, hi = F.floor("_pos"), F.ceil("_pos")
    end = F.col("_start") + F.col("_bn")
    wanted = spans.where(((lo >= F.col("_start")) & (lo < end)) | ((hi >= F.col("_start")) & (hi < end)))
    inner = Window.partitionBy(*keys, "_b").orderBy("_v")
    placed = (
        counted.join(wanted.drop("_bn"), [*keys, "_b"])
        .withColumn("_to", F.col("_start") + F.sum("_n").over(inner))
        .withColumn("_from", F.col("_to") - F.col("_n"))
    )
    low = F.max(F.when((lo >= F.col("_from")) & (lo < F.col("_to")), F.col("_v")))
    high = F.max(F.when((hi >= F.col("_from")) & (hi < F.col("_to")), F.col("_v")))
    share = F.max(F.col("_pos") - lo)
    return placed.groupBy(*keys).agg((low + (high - low) * share).alias(name))
