"""Ranks, running sums, quantiles and random orders over whole tables.

A Spark window without (or with a hot) partition key sorts everything in one
task. The operators here cut the order into ranges instead: rows are
range-partitioned on (keys, order), sorted inside each range and pinned, so a
row's place is `rows in earlier ranges + place in its own range`. A key holding
a third of the table simply spans many ranges. What is gathered per key in one
task is never more than one row per range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seedlift.runtime import pin, range_count

RANGE, AT = "_range", "_at"

# Offsets of monotonically_increasing_id: partition number above bit 33.
_OFFSET_BITS = 33


def _names(cols: Sequence[str] | str) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def join_alike(rows: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where null equals null; the keys come from `rows`, whose column order stays."""
    renamed = table.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in table.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in on])
    return rows.join(renamed, same, how).drop(*[f"_on_{c}" for c in on])


def lay_out(df: DataFrame, order: Sequence[Column | str], ranges: int | None = None) -> DataFrame:
    """Pin `df` in global `order`; adds the range number and the row's offset in it.

    Range borders come from sampling, so they are only fixed once written; that is
    why the result is pinned before any count is taken from it.
    """
    n = ranges or range_count(df)
    laid = (
        df.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    mask = (1 << _OFFSET_BITS) - 1
    return (
        pin(laid, "ordered")
        .withColumn(RANGE, F.shiftright("_place", _OFFSET_BITS))
        .withColumn(AT, F.col("_place").bitwiseAND(F.lit(mask)))
        .drop("_place")
    )


def running(
    df: DataFrame,
    order: Sequence[Column | str],
    sums: Mapping[str, Column],
    keys: Sequence[str] = (),
    totals: bool = False,
    ranges: int | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """Inclusive running sums of `sums` in `order` within `keys`; null is a key like any other.

    With `totals`, `<name>_total` carries the sum over the whole key.
    """
    keys = _names(keys)
    for name, expr in sums.items():
        df = df.withColumn(name, expr)
    laid = lay_out(df, [F.col(k) for k in keys] + list(order), ranges)
    by = [RANGE, *keys]
    per_range = laid.groupBy(*by).agg(*[F.sum(s).alias(s) for s in sums])
    # One row per (key, range): bounded by the number of ranges, not by the data.
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    bases = per_range.select(
        *by,
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_base_{s}") for s in sums],
        *([F.sum(s).over(whole).alias(f"{s}_total") for s in sums] if totals else []),
    )
    inside = Window.partitionBy(*by).orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    rows = laid.select(
        *[c for c in laid.columns if c not in sums],
        *[F.sum(s).over(inside).alias(s) for s in sums],
    )
    out = join_alike(rows, bases, by)
    for s in sums:
        out = out.withColumn(s, F.col(s) + F.col(f"_base_{s}"))
    drop = [f"_base_{s}" for s in sums] + ([] if keep_range else [RANGE, AT])
    return out.drop(*drop)


def number_rows(
    df: DataFrame,
    order: Sequence[Column | str],
    name: str = "position",
    keys: Sequence[str] = (),
    total: str | None = None,
    ranges: int | None = None,
    keep_range: bool = False,
) -> DataFrame:
    """`row_number()` in `order` within `keys`, for tables and keys of any size.

    End `order` with a unique column to make the numbering repeatable.
    """
    keys = _names(keys)
    if keys:
        out = running(df, order, {name: F.lit(1).cast("bigint")}, keys, bool(total), ranges, keep_range)
        return out.withColumnRenamed(f"{name}_total", total) if total else out
    laid = lay_out(df, order, ranges)
    sizes = laid.groupBy(RANGE).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        RANGE,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        *([F.sum("_size").over(Window.partitionBy()).alias(total)] if total else []),
    )
    # One row per range, so the broadcast is bounded by the range count.
    out = laid.join(F.broadcast(starts), RANGE).withColumn(name, F.col("_start") + F.col(AT) + 1)
    return out.drop("_start", *([] if keep_range else [RANGE, AT]))


def average_ranks(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    name: str = "rank_avg",
    total: str = "n",
) -> DataFrame:
    """Ascending rank with ties given their mean rank, and the key's count of values.

    Equal values are merged before anything is put in order, so `df` itself is never
    sorted. A null value keeps its row and gets a null rank.
    """
    keys = _names(keys)
    steps = value_steps(df.filter(F.col(value).isNotNull()), value, {"_upto": F.lit(1).cast("bigint")}, keys)
    ranks = steps.select(*keys, value, (F.col("_upto") - (F.col("_upto_here") - 1) / F.lit(2.0)).cast("double").alias(name))
    sizes = steps.groupBy(*keys).agg(F.max("_upto_total").alias(total))
    out = join_alike(df, ranks, [*keys, value], "left")
    return join_alike(out, sizes, keys, "left") if keys else out.join(F.broadcast(sizes), F.lit(True), "left")


def percentile_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "percentile") -> DataFrame:
    """100 * average rank / count of values."""
    ranked = average_ranks(df, value, keys, "_rank", "_n")
    return ranked.withColumn(name, F.lit(100.0) * F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    tiebreak: Sequence[str] | str = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """Exact linearly interpolated quantiles as rows `(keys..., prob, quantile, n)`; nulls skipped.

    `tiebreak` spreads a value holding much of the table over several ranges.
    """
    keys = _names(keys)
    narrow = df.select(*keys, F.col(value).cast("double").alias("_v"),
                       *[F.col(t).alias(f"_t{i}") for i, t in enumerate(_names(tiebreak))])
    ties = [f"_t{i}" for i in range(len(_names(tiebreak)))]
    rows = number_rows(narrow.filter(F.col("_v").isNotNull()), [F.col("_v"), *ties], "_pos", keys, "_n")
    at = [(F.col("_n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.lit(False)
    for h in at:
        wanted = wanted | (F.col("_pos") == F.floor(h) + 1) | (F.col("_pos") == F.ceil(h) + 1)
    picks = rows.filter(wanted).select(
        *keys, "_v", "_pos", "_n",
        F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob"),
    )
    h = (F.col("_n") - 1) * F.col("prob")
    low = F.max(F.when(F.col("_pos") == F.floor(h) + 1, F.col("_v")))
    high = F.max(F.when(F.col("_pos") == F.ceil(h) + 1, F.col("_v")))
    part = F.max(h - F.floor(h))
    return picks.groupBy(*keys, "prob").agg(
        (low + (high - low) * part).alias("quantile"), F.max("_n").alias("n"))


def value_steps(df: DataFrame, value: str, sums: Mapping[str, Column], keys: Sequence[str] = (),
                descending: bool = False) -> DataFrame:
    """One row per distinct `value` with running sums and totals: the base of ROC, ECDF, U tests.

    Equal values are merged before the order is taken, so a hot value is one row.
    """
    keys = _names(keys)
    merged = df.groupBy(*keys, value).agg(*[F.sum(e).alias(f"{s}_here") for s, e in sums.items()])
    order = F.col(value).desc() if descending else F.col(value)
    return running(merged, [order], {s: F.col(f"{s}_here") for s in sums}, keys, totals=True)


def shuffled_positions(
    df: DataFrame,
    id_col: str,
    salt: str,
    keys: Sequence[str] = (),
    salted_by: Sequence[str] | None = None,
    name: str = "rn",
    total: str | None = None,
    digits: int = 3,
) -> DataFrame:
    """Random but repeatable order: position by md5(salt:keys:id) within `keys`.

    md5 is uniform, so its leading hex digits cut the order into 16**digits even
    buckets without sampling; each bucket is numbered on its own.
    `salted_by` names the key columns that enter the hash (default: all).
    """
    keys = _names(keys)
    salted = keys if salted_by is None else _names(salted_by)
    parts = [F.lit(salt), *[F.col(k).cast("string") for k in salted], F.col(id_col).cast("string")]
    hashed = (
        df.withColumn("_md5", F.md5(F.concat_ws(":", *parts)))
        .withColumn("_bucket", F.substring("_md5", 1, digits))
    )
    sizes = hashed.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(  # at most 16**digits rows per key
        *keys, "_bucket",
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"),
        *([F.sum("_size").over(Window.partitionBy(*keys)).alias(total)] if total else []),
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_md5", id_col)
    return (
        join_alike(hashed.withColumn("_nth", F.row_number().over(inside)), starts, [*keys, "_bucket"])
        .withColumn(name, (F.col("_start") + F.col("_nth")).cast("bigint"))
        .drop("_md5", "_bucket", "_start", "_nth")
    )
