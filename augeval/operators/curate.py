"""Curation: typed values, validity, row filters, either-key merge, funnel counts and set profiles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from augeval.functions.keys import numeric_or_null
from augeval.functions.quantiles import with_quantiles


# ---------------------------------------------------------------- row-level rules

def affine(df: DataFrame, cols: Sequence[str], a: float, b: float, array_cols: Sequence[str] = ()) -> DataFrame:
    """Unit change ``a * x + b`` on scalar columns and inside array columns (e.g. kelvin to celsius: a=1, b=-273.15)."""
    for c in cols:
        df = df.withColumn(c, F.col(c) * F.lit(a) + F.lit(b))
    for c in array_cols:
        df = df.withColumn(c, F.transform(c, lambda x: x * F.lit(a) + F.lit(b)))
    return df


def numeric(df: DataFrame, col: str, out: str | None = None, drop_null: bool = True) -> DataFrame:
    """Text to double (null when not a plain number), then drop the nulls."""
    out = out or col
    df = df.withColumn(out, numeric_or_null(col))
    return df.filter(F.col(out).isNotNull()) if drop_null else df


def valid(df: DataFrame, key_col: str) -> DataFrame:
    """Drop rows whose key could not be computed."""
    return df.filter(F.col(key_col).isNotNull())


def marker_count(c, marker: str) -> Column:
    """Occurrences of a one-character marker."""
    c = F.col(c) if isinstance(c, str) else c
    return F.length(c) - F.length(F.replace(c, F.lit(marker), F.lit("")))


def markers(df: DataFrame, col: str, marker: str, k: int) -> DataFrame:
    """Keep rows with exactly k markers."""
    return df.filter(marker_count(col, marker) == k)


def single_fragment(df: DataFrame, col: str, sep: str = ".") -> DataFrame:
    """Drop rows made of several fragments."""
    return df.filter(~F.col(col).contains(sep))


def between(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Inclusive range rule (NaN and null excluded)."""
    return df.filter(F.col(col).between(F.lit(lo), F.lit(hi)) & ~F.isnan(col))


def measurements(df: DataFrame, list_col: str, value_col: str, out: str = "values") -> DataFrame:
    """A text list literal ``"[a, b]"`` to array<double>; a row without a list keeps its single value."""
    parsed = F.try_parse_json(F.col(list_col))
    arr = F.when(F.col(list_col).startswith("["), F.try_variant_get(parsed, "$", "array<double>"))
    return df.withColumn(out, F.coalesce(arr, F.array(F.col(value_col).cast("double"))))


# ---------------------------------------------------------------- merges (A1, A2)

def merge_duplicates(df: DataFrame, id_col: str = "entity_id", key_col: str = "exact_key",
                     value_col: str = "value", by: Sequence[str] = ()) -> DataFrame:
    """One row per entity: the smallest spelling and the median value.

    ``median`` is Spark's exact percentile; its partial aggregate keeps a value->count map per group,
    so a hot entity costs memory by its distinct values, not by its rows.
    """
    keys = [*by, id_col]
    return df.groupBy(*keys).agg(F.min(key_col).alias("smiles"), F.median(value_col).alias("value"))


def merge_measurements(df: DataFrame, id_col: str = "entity_id", key_col: str = "exact_key",
                       value_col: str = "value", n_col: str = "n_points", tag_col: str = "source",
                       class_col: str = "class", by: Sequence[str] = ()) -> DataFrame:
    """Merge with pooled measurements: sum of points, joined distinct tags, first class, merged row count, the median of the
    row values, and number and SD of the pooled measurements (a list column ``values`` if there is one, else the
    row values; the SD is null for one value). An entity with empty lists keeps its row, with 0 measurements.

    Number and SD come from the exploded values, so the pooled array is never the aggregation state."""
    keys = [*by, id_col]
    value = F.median(value_col).alias("value")
    first_class = F.min_by(F.col(class_col), F.struct(F.col(key_col), F.col(class_col)))
    rows = df.groupBy(*keys).agg(
        F.min(key_col).alias("smiles"), F.sum(n_col).alias("n_points"),
        F.array_join(F.array_sort(F.collect_set(tag_col)), "/").alias("sources"),
        first_class.alias("class"), F.count(F.lit(1)).alias("rows_merged"), value,
        *([] if "values" in df.columns else [F.stddev_samp(value_col).alias("value_sd"), F.count(value_col).alias("n_values")]))
    if "values" not in df.columns:
        return rows
    pooled = df.select(*keys, F.explode("values").alias("_v")).groupBy(*keys).agg(
        F.stddev_samp("_v").alias("value_sd"), F.count("_v").alias("n_values"))
    return rows.join(pooled, keys, "left").fillna(0, ["n_values"])


# ---------------------------------------------------------------- funnel

def cleaning_funnel(df: DataFrame, rules: Sequence[tuple[str, Column]], matched: DataFrame, held: Sequence[str],
                    by: str = "synthetic_set", key_col: str = "exact_key") -> DataFrame:
    """Rows left after each rule, in the caller's order, as a long (set, step_order, step, n) table.

    ``rules`` are (name, predicate) pairs, applied one after the other: a row counts for a rule if it passes that rule and
    all before it, however Catalyst orders filters. ``matched`` has one row per merged entity with a column
    ``<name>_match`` (null, 'exact', 'alt') for each held-out set in ``held``. Steps: raw, the rules, distinct_keys,
    distinct_entities, and per held-out set <name>_exact, <name>_alt and after_<name>. One pass per input, distinct
    keys by a two-level count."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("raw")]
    for name, predicate in rules:
        passed = passed & predicate
        counts.append(F.count_if(passed).cast("bigint").alias(name))
    names = ["raw", *[name for name, _ in rules]]
    rows = df.groupBy(by, key_col).agg(*counts).groupBy(by).agg(
        *[F.sum(c).alias(c) for c in names],
        F.count_if(F.col(key_col).isNotNull() & (F.col(names[-1]) > 0)).cast("bigint").alias("distinct_keys"))
    left, ents = F.lit(True), [F.count(F.lit(1)).alias("distinct_entities")]
    for h in held:
        m = F.col(f"{h}_match")
        ents += [F.count_if(left & (m == kind)).cast("bigint").alias(f"{h}_{kind}") for kind in ("exact", "alt")]
        left = left & m.isNull()
        ents.append(F.count_if(left).cast("bigint").alias(f"after_{h}"))
    steps = [*names, "distinct_keys", "distinct_entities", *[x for h in held for x in (f"{h}_exact", f"{h}_alt", f"after_{h}")]]
    wide = rows.join(matched.groupBy(by).agg(*ents), by, "left").fillna(0)
    stack = ", ".join(f"{i}, '{c}', `{c}`" for i, c in enumerate(steps))
    return wide.selectExpr(by, f"stack({len(steps)}, {stack}) AS (step_order, step, n)")


def funnel_removed(funnel: DataFrame, by: str = "synthetic_set") -> DataFrame:
    """Rows removed by each counting step (the detail lines per match kind are skipped), via ``lag`` over step order.

    The window is per set over a table of a dozen rows per set."""
    from pyspark.sql import Window
    steps = funnel.filter(~F.col("step").rlike("_(exact|alt)$"))
    w = Window.partitionBy(by).orderBy("step_order")
    return steps.withColumn("removed", F.lag("n").over(w) - F.col("n"))


# ---------------------------------------------------------------- profiles

def distribution_stats(df: DataFrame, value_col: str = "value", by: Sequence[str] = ("set",),
                       n_col: str | None = None) -> DataFrame:
    """n, mean, SD, min, median, max (and rows with 2+ points) per table."""
    aggs = [F.count(value_col).alias("n"), F.avg(value_col).alias("mean"), F.stddev_samp(value_col).alias("sd"),
            F.min(value_col).alias("min"), F.max(value_col).alias("max")]
    if n_col:
        aggs.append(F.count_if(F.col(n_col) >= 2).cast("bigint").alias("n_multi"))
    return with_quantiles(df.groupBy(*by).agg(*aggs), df, value_col, {"median": 0.5}, by)


def value_counts_topk(df: DataFrame, col: str, k: int) -> DataFrame:
    """Top k values with count and share; ties broken by value. A top-k report: the limit is the feature."""
    total = df.select(F.count(F.lit(1))).scalar()          # scalar subquery, no join
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), F.asc(col)).limit(k)
    return top.select(col, "n", (F.col("n") / total).alias("share"))


def label_concentration(df: DataFrame, col: str, v: float, t: float, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values, share equal to v, count and share above t."""
    return df.groupBy(*by).agg(
        F.count_distinct(col).alias("distinct_values"),
        F.avg(F.when(F.col(col) == v, 1.0).otherwise(0.0)).alias("share_equal"),
        F.count_if(F.col(col) > t).cast("bigint").alias("n_above"),
        F.avg(F.when(F.col(col) > t, 1.0).otherwise(0.0)).alias("share_above"))


def repeat_spread(df: DataFrame, id_col: str, value_col: str, min_repeats: int = 3) -> DataFrame:
    """Largest repeat count; median SD among entities seen ``min_repeats``+ times; how many such entities."""
    per = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n"), F.stddev_samp(value_col).alias("_sd"))
    often = F.col("_n") >= min_repeats
    g = per.agg(F.max("_n").alias("max_repeats"), F.count_if(often).cast("bigint").alias("n_repeated"))
    return with_quantiles(g, per.where(often), "_sd", {"median_sd_repeated": 0.5})


def category_counts(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def key_coverage(df: DataFrame, alt_col: str = "alt_key", by: Sequence[str] = ()) -> DataFrame:
    """Rows without an alt key, count and share."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                               F.count_if(F.col(alt_col).isNull()).cast("bigint").alias("n_without_alt"),
                               F.avg(F.when(F.col(alt_col).isNull(), 1.0).otherwise(0.0)).alias("share_without_alt"))


# ---------------------------------------------------------------- set operations

def union_tagged(frames: dict[str, DataFrame], tag: str = "set") -> DataFrame:
    out = None
    for name, df in frames.items():
        df = df.withColumn(tag, F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def distinct_keys(df: DataFrame, key_col: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(key_col).isNotNull()).select(*by, key_col).distinct()
