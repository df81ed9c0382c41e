"""Row numbers, running totals, exact quantiles and exact sampling for groups of any size.

A plain window sorts a whole group in one task. Here each group is first cut into
ordered buckets by a rule that depends on the row alone. Counts per bucket give every
bucket its starting position, and only the rows inside one bucket are sorted together.
A group that holds a third of all rows is therefore spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.numbers import hash_order
from tickerloom.session import durable, join_on, small_side

BUCKET_ROWS = 1_000_000
BUCKET_BITS = 11


def rows_before(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def sum_before(value: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.coalesce(F.sum(value).over(rows_before(keys, order)), F.lit(0))


def row_index(df: DataFrame, date_col: str, seq_col: str | None = None, by: Sequence[str] = (),
              name: str = "row_id", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Zero-based position of each row in (date, seq) order, per group of `by`.

    seq_col is an integer, unique within a date. Rows are counted per
    (date, seq div bucket_rows); the running sum over dates has one row per calendar date,
    the one over buckets is taken inside a date, and only rows of one bucket are numbered
    together. Without seq_col the date itself must be unique in the group.
    """
    by = list(by)
    if seq_col is None:
        position = F.row_number().over(Window.partitionBy(*by).orderBy(date_col))
        return df.withColumn(name, (position - 1).cast("bigint"))
    cell_keys = by + [date_col, "_cell"]
    rows = df.withColumn("_cell", F.floor(F.try_divide(F.col(seq_col), F.lit(bucket_rows))).cast("bigint"))
    cells = durable(rows.groupBy(*cell_keys).agg(F.count(F.lit(1)).alias("_n")))
    days = cells.groupBy(*by, date_col).agg(F.sum("_n").alias("_n"))
    day_start = days.select(*by, date_col, sum_before("_n", by, [date_col]).alias("_day_start"))
    cell_start = cells.select(*cell_keys, sum_before("_n", by + [date_col], ["_cell"]).alias("_cell_start"))
    starts = join_on(cell_start, day_start, by + [date_col]).select(
        *cell_keys, (F.col("_day_start") + F.col("_cell_start")).alias("_start"))
    inside = Window.partitionBy(*cell_keys).orderBy(seq_col)
    return (join_on(rows, starts, cell_keys)
            .withColumn(name, (F.col("_start") + F.row_number().over(inside) - 1).cast("bigint"))
            .select(*df.columns, name))


def value_bucket(value: str, bounds: str, bits: int = BUCKET_BITS) -> Column:
    """Number of sorted bounds at or below the value, found by halving steps."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(bits))])
    return F.aggregate(
        steps, F.lit(0),
        lambda seen, step: F.when(F.get(F.col(bounds), seen + step - 1) <= F.col(value), seen + step).otherwise(seen))


def cut_by_value(df: DataFrame, value: str, bits: int = BUCKET_BITS) -> DataFrame:
    """Add _bucket, an ordered bucket number, to each row.

    Bounds are approximate quantiles of all values (a scan without a shuffle). Hence no
    (group, bucket) holds much more than 1 / 2**bits of the rows, whatever the group sizes
    are, apart from repetitions of one value, which aggregate to one row. Bounds only
    decide which task handles a row, so results built on the buckets are exact.
    """
    parts = 1 << bits
    # One text literal keeps the plan short; it folds to an array before execution.
    fractions = F.split(F.lit(",".join(str(i / parts) for i in range(1, parts))), ",").cast("array<double>")
    bounds = df.agg(F.percentile_approx(F.col(value).cast("double"), fractions, F.lit(parts * 4)).alias("_bounds"))
    return (df.withColumn("_bounds", bounds.scalar())
            .withColumn("_bucket", value_bucket(value, "_bounds", bits)).drop("_bounds"))


def unpivot_metrics(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, value) rows without NULL and NaN."""
    doubles = df.select(*by, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols])
    return doubles.unpivot(list(by), list(cols), "metric", "value").where(F.col("value").isNotNull())


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                    by: Sequence[str] = (), bits: int = BUCKET_BITS) -> DataFrame:
    """Linearly interpolated quantiles: one row per (by, metric), columns q0, q1, ...

    A selection in three scans: bucket bounds, rows per bucket, and the rows of the few
    buckets that hold a wanted rank. Only bucket counts and those rows are shuffled, never
    the whole column.
    """
    by = list(by)
    keys = by + ["metric"]
    cut = cut_by_value(unpivot_metrics(df, cols, by), "value", bits)
    cells = cut.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_in"))
    starts = cells.withColumns({"_start": sum_before("_in", keys, ["_bucket"]),
                                "n_total": F.sum("_in").over(Window.partitionBy(*keys))})
    spots = [F.lit(float(p)) * (F.col("n_total") - 1) for p in probs]

    def holds(rank: Column, start: Column, size: Column) -> Column:
        return (start <= rank) & (rank < start + size)

    ranks = [r for spot in spots for r in (F.floor(spot), F.ceil(spot))]
    wanted = starts.where(reduce(or_, [holds(r, F.col("_start"), F.col("_in")) for r in ranks])).drop("_in")
    near = join_on(cut, small_side(wanted), keys + ["_bucket"]).groupBy(*keys, "_bucket", "_start", "n_total", "value").agg(
        F.count(F.lit(1)).alias("n"))
    near = near.withColumn("n_before", F.col("_start") + sum_before("n", keys + ["_bucket"], ["value"]))

    def value_at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, F.col("n_before"), F.col("n")), F.col("value")))

    picks, outs = [], []
    for i, spot in enumerate(spots):
        picks += [value_at(F.floor(spot)).alias(f"_lo{i}"), value_at(F.ceil(spot)).alias(f"_hi{i}"),
                  F.max(spot - F.floor(spot)).alias(f"_f{i}")]
        outs.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_f{i}")).alias(f"q{i}"))
    return near.groupBy(*keys).agg(*picks).select(*keys, *outs)


def take_by_hash(df: DataFrame, keys: Sequence[str], quota_of: Callable[[DataFrame], DataFrame], id_col: str,
                 seed: int = 0, flag: str = "picked") -> DataFrame:
    """Mark, per group, exactly `quota` rows with the smallest id hashes.

    quota_of gets the group sizes (keys, n) and adds the column `quota`. The hash range is cut into 2048 equal parts. Counts per part tell which part the quota
    cuts: earlier parts are taken whole, later ones left, and rows are ranked only inside
    that part. Rows meet one cut per group, and no row is shuffled but those of cut parts.
    """
    keys = list(keys)
    rows = df.withColumn("_h", hash_order(id_col, seed)).withColumn("_part", F.shiftright("_h", 20))
    parts = durable(rows.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n")))
    quotas = quota_of(parts.groupBy(*keys).agg(F.sum("_n").alias("n")))
    left = F.col("quota") - sum_before("_n", keys, ["_part"])
    over = join_on(parts, quotas.select(*keys, "quota"), keys).withColumn("_left", left).where(F.col("_n") > F.col("_left"))
    first = over.groupBy(*keys).agg(F.min("_part").alias("_cut"), F.min_by("_left", "_part").alias("_rest"))
    cuts = join_on(quotas.select(*keys), first, keys, "left").select(
        *keys, F.coalesce("_cut", F.lit(1 << 11)).alias("_cut"), F.coalesce("_rest", F.lit(0)).alias("_rest"))
    joined = join_on(rows, small_side(cuts), keys, "left")
    on_cut = F.coalesce(F.col("_part") == F.col("_cut"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_h", id_col))
    whole = joined.where(~on_cut).withColumn(flag, F.coalesce(F.col("_part") < F.col("_cut"), F.lit(False)))
    edge = joined.where(on_cut).withColumn(flag, rank <= F.col("_rest"))
    return whole.unionByName(edge).select(*df.columns, flag)
