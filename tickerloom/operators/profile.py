"""Descriptive statistics, correlations, histograms and word counts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations_with_replacement
from operator import or_

from pyspark.sql import Column, DataFrame, Window, functions as F

from tickerloom.functions.numbers import clean_double
from tickerloom.functions.tails import student_t_two_sided
from tickerloom.functions.text import ENGLISH_STOP_WORDS, blank_tokens, words_of
from tickerloom.operators.ordering import unpivot_metrics
from tickerloom.session import durable, join_on, small_side

#: Greatest error of a quantile sketch, distance of bounds from a wanted quantile (shares of the rows), and rows that are kept whole.
ERROR, MARGIN, WHOLE = 1e-4, 5e-4, 10_000


def value_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def moments_and_brackets(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(values, marks): (by, metric, value) rows with their marks, and one stored row of marks per (by, metric), from one scan.

    Marks are n, mean, std, min, max, and for each probability i the bounds lo_i and hi_i. The exact quantile, and
    both values that it lies between, are inside: sketches are off by a share of ERROR of the rows at most, bounds
    are MARGIN away, and groups of up to WHOLE rows are not narrowed at all.
    """
    keys = [*by, "metric"]
    values = unpivot_metrics(df, cols, by)
    spots = [min(1.0, max(0.0, p + d)) for p in probs for d in (-MARGIN, MARGIN)]
    marks = values.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.percentile_approx("value", spots, round(1 / ERROR)).alias("_m"))
    ends = {}
    for i in range(len(probs)):
        ends[f"lo_{i}"] = F.when(F.col("n") <= WHOLE, F.col("min")).otherwise(F.get("_m", F.lit(2 * i)))
        ends[f"hi_{i}"] = F.when(F.col("n") <= WHOLE, F.col("max")).otherwise(F.get("_m", F.lit(2 * i + 1)))
    marks = small_side(marks.withColumns(ends).drop("_m"))
    return join_on(values, marks, keys), marks


def quantile_cells(values: DataFrame, keys: Sequence[str], probs: int, kept: Column, *extra: Column) -> DataFrame:
    """Rows per value inside a bracket, one row for all other values (value NULL), and how many are below each bracket."""
    inside = reduce(or_, [F.col("value").between(F.col(f"lo_{i}"), F.col(f"hi_{i}")) for i in range(probs)]) | kept
    below = [F.count(F.when(F.col("value") < F.col(f"lo_{i}"), 1)).alias(f"below_{i}") for i in range(probs)]
    return values.groupBy(*keys, F.when(inside, F.col("value")).alias("v")).agg(F.count(F.lit(1)).alias("c"), *below, *extra)


def picked(cells: DataFrame, marks: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The keys with the linearly interpolated quantiles q0, q1, ... from the cells of brackets."""
    ordered, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
    rows = join_on(cells, marks, keys)
    new, picks, outs = {}, [], []
    for i, p in enumerate(probs):
        here = F.when(F.col("v").between(F.col(f"lo_{i}"), F.col(f"hi_{i}")), F.col("c")).otherwise(0)
        new[f"_end{i}"] = F.sum(f"below_{i}").over(whole) + F.sum(here).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        new[f"_here{i}"] = here
    rows = rows.withColumns(new)
    for i, p in enumerate(probs):
        spot = F.lit(float(p)) * (F.col("n") - 1)

        def value_at(rank: Column, i: int = i) -> Column:
            held = (F.col(f"_end{i}") - F.col(f"_here{i}") <= rank) & (rank < F.col(f"_end{i}"))
            return F.max(F.when(held & (F.col(f"_here{i}") > 0), F.col("v")))

        picks += [value_at(F.floor(spot)).alias(f"_a{i}"), value_at(F.ceil(spot)).alias(f"_b{i}"), F.max(spot - F.floor(spot)).alias(f"_f{i}")]
        outs.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * F.col(f"_f{i}")).alias(f"q{i}"))
    return rows.groupBy(*keys).agg(*picks).select(*keys, *outs)


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, max per column; one row per (by, metric).

    Two scans: the first gives moments and bounds of the quartiles, the second counts the values inside the bounds.
    """
    keys, probs = [*by, "metric"], [0.25, 0.5, 0.75]
    values, marks = moments_and_brackets(df, cols, probs, by)
    found = picked(quantile_cells(values, keys, len(probs), F.lit(False)), marks, keys, probs)
    return join_on(marks, found, keys).select(
        *keys, "n", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"),
        F.col("q2").alias("p75"), "max")


def pearson(a: str, b: str) -> Column:
    """Correlation over rows where both are present; NULL when undefined."""
    r = F.corr(clean_double(a), clean_double(b))
    return F.nanvl(r, F.lit(None).cast("double"))


def correlation_matrix(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Long form (a, b, r) of the full matrix, from one aggregation over the pairs a <= b."""
    pairs = list(combinations_with_replacement(cols, 2))
    row = df.groupBy(*by).agg(*[pearson(a, b).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(left).alias("a"), F.lit(right).alias("b"), F.col(f"r{i}").alias("r")))
    return row.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.a", "c.b", "c.r")


def correlation_with(df: DataFrame, cols: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Correlation of each column with one target."""
    row = df.groupBy(*by).agg(*[pearson(c, target).alias(c) for c in cols])
    return row.unpivot(list(by), list(cols), "feature", "r")


def pearson_test(df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()) -> DataFrame:
    """r, n and the two-sided p-value for pairs of columns; p-values act on reduced rows."""
    aggs = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [pearson(a, b).alias(f"r{i}"), F.count(F.when(both, 1)).alias(f"n{i}")]
    row = df.groupBy(*by).agg(*aggs)
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n"))
             for i, (a, b) in enumerate(pairs)]
    long = row.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2.0, 1 - F.col("r") * F.col("r")))
    return long.withColumn("t", t).withColumn(
        "p_value", student_t_two_sided(F.col("t"), (F.col("n") - 2).cast("double")))


def token_length_stats(df: DataFrame, text: str) -> DataFrame:
    sizes = df.select(F.size(blank_tokens(text)).alias("n"))
    return sizes.agg(F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.avg("n").alias("mean_tokens"))


def word_counts(df: DataFrame, text: str, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Rows per word. Words are counted per map task first, so frequent words do not skew.

    The stop-word list is a fixed set, hence a filter and not a join.
    """
    words = df.select(F.explode(words_of(text)).alias("word"))
    if stop_words:
        words = words.where(~F.col("word").isin(list(stop_words)))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def word_frequency(df: DataFrame, text: str, top: int, drop_stop_words: bool = False) -> DataFrame:
    counts = word_counts(df, text, ENGLISH_STOP_WORDS if drop_stop_words else None)
    return counts.orderBy(F.desc("n"), "word").limit(top)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * class count)."""
    counts = value_counts(df, [label])
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))).scalar()
    return counts.withColumn("_t", total).select(
        label, "n", (F.col("_t.n") / (F.col("_t.k") * F.col("n"))).alias("weight"))


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """Counts in equal-width bins between min and max; the last bin is closed."""
    values = df.select(clean_double(c).alias("x")).where(F.col("x").isNotNull())
    ends = values.agg(F.struct(F.min("x").alias("lo"), F.max("x").alias("hi"))).scalar()
    spot = F.floor(F.try_divide((F.col("x") - F.col("_e.lo")) * bins, F.col("_e.hi") - F.col("_e.lo")))
    hits = values.withColumn("_e", ends).select(
        F.least(F.coalesce(spot, F.lit(0)), F.lit(bins - 1)).cast("bigint").alias("bin"))
    counts = hits.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").alias("bin")).withColumn("_e", ends)
    width = (F.col("_e.hi") - F.col("_e.lo")) / bins
    return spine.join(counts, "bin", "left").select(
        "bin", (F.col("_e.lo") + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).alias("n"))


def box_stats(df: DataFrame, c: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 IQR) and number of outliers per group, in two scans as `describe`.

    Bounds of the quartiles give bounds of the fences, so the second scan also keeps the values that are near a fence.
    """
    keys, probs = [*by, "metric"], [0.25, 0.5, 0.75]
    values, marks = moments_and_brackets(df.select(*by, clean_double(c).alias(c)), [c], probs, by)
    (a, b), (y, z) = (F.col("lo_0"), F.col("hi_0")), (F.col("lo_2"), F.col("hi_2"))
    low, high = (a - 1.5 * (z - a), b - 1.5 * (y - b)), (y + 1.5 * (y - b), z + 1.5 * (z - a))
    x = F.col("value")
    near = x.between(*low) | x.between(*high)
    cells = durable(quantile_cells(values, keys, len(probs), near, F.min(F.when(x > low[1], x)).alias("first_in"), F.max(F.when(x < high[0], x)).alias("last_in"),
                                   F.count(F.when((x < low[0]) | (x > high[1]), 1)).alias("out")))
    marked = join_on(picked(cells, marks, keys, probs), marks, keys)
    spread = 1.5 * (F.col("q2") - F.col("q0"))
    fences = marked.select(*keys, "q0", "q1", "q2", (F.col("q0") - spread).alias("_lo"), (F.col("q2") + spread).alias("_hi"),
                           low[1].alias("_near_lo"), high[0].alias("_near_hi"), low[0].alias("_far_lo"), high[1].alias("_far_hi"))
    rows, v = join_on(cells, small_side(fences), keys), F.col("v")
    out = F.sum("out") + F.sum(F.when((v.between(F.col("_far_lo"), F.col("_lo")) & (v < F.col("_lo"))) | (v.between(F.col("_hi"), F.col("_far_hi")) & (v > F.col("_hi"))), F.col("c")).otherwise(0))
    # Values above the near bound of a fence are inside; of the kept ones, those from the fence on.
    inside = v.between(F.col("_lo"), F.col("_hi"))
    reach = F.when(F.col("first_in").between(F.col("_lo"), F.col("_hi")), F.col("first_in")), F.when(F.col("last_in").between(F.col("_lo"), F.col("_hi")), F.col("last_in"))
    return rows.groupBy(*by).agg(
        F.first("q0").alias("q1"), F.first("q1").alias("median"), F.first("q2").alias("q3"),
        F.least(F.min(F.when(inside, v)), F.min(reach[0])).alias("whisker_low"),
        F.greatest(F.max(F.when(inside, v)), F.max(reach[1])).alias("whisker_high"), out.alias("outliers"))
