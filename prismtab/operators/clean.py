"""Cleaning: standard names, exact and fuzzy dedup, imputation, and the three in a row."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtab.functions.columns import distinct_names, normalise, numeric_columns, snake_case, string_columns, strip
from prismtab.functions.store import cut


def standardize(df: DataFrame) -> DataFrame:
    """snake_case names, and text without white space at its ends. Names that collide get _2, _3 ... behind them."""
    out = df.toDF(*distinct_names([snake_case(c) for c in df.columns]))
    return out.withColumns({c: strip(c) for c in string_columns(out)})


def dedup_exact(df: DataFrame, subset: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The first row, by order, of each kind in subset (all columns). Missing values are equal. Without order any row of the kind may stay, which only matters beyond subset."""
    keys = subset or df.columns
    if not order:
        return df.dropDuplicates(keys)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn__", F.row_number().over(w)).filter("rn__ = 1").drop("rn__")


def fuzzy_key(c: str) -> Column:
    """Lower case, trimmed, only letters a-z, digits and white space, the latter collapsed; null is empty."""
    x = strip(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(x, r"[^a-z0-9\s]", ""), r"\s+", " ")


def dedup_fuzzy(df: DataFrame, order: list[str], subset: list[str] | None = None, threshold: float = 0.85) -> DataFrame:
    """Rows whose text columns of subset agree, after normalisation, with those of no earlier kept row in a share of threshold or more.

    Without subset or text columns in it, exact dedup. If all columns must agree, it is a window over the
    normalised key. Otherwise rows that agree are equal in some choice of as many columns as must agree; see _greedy.
    """
    texts = [c for c in (subset or []) if isinstance(df.schema[c].dataType, T.StringType)]
    if not texts:
        return dedup_exact(df, subset, order)
    keyed = df.withColumns({f"k__{i}": fuzzy_key(c) for i, c in enumerate(texts)})
    keys = [f"k__{i}" for i in range(len(texts))]
    k = len(texts)
    if threshold > (k - 1) / k:
        w = Window.partitionBy(*keys).orderBy(*order)
        return keyed.withColumn("rn__", F.row_number().over(w)).filter("rn__ = 1").drop("rn__", *keys)
    return _greedy(keyed, keys, order, threshold).drop(*keys)


def _greedy(keyed: DataFrame, keys: list[str], order: list[str], threshold: float) -> DataFrame:
    """A row goes if an earlier row that stays agrees with it. Rows with equal keys are settled first; the others in rounds.

    Two rows agree if they are equal in some choice of `need` columns, so each choice deals the rows into groups within
    which all agree, and no pair is ever made. In each round a row that is the first undecided one of all its
    groups stays, and all others of its groups go. """
    need = max(1, math.ceil(threshold * len(keys) - 1e-9))
    choices = list(combinations(range(len(keys)), need))
    first = keyed.withColumn("rn__", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("rn__ = 1").drop("rn__")
    groups = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.array(*[F.col(keys[k]) for k in c]).alias("v")) for i, c in enumerate(choices)]))
    undecided = cut(first.select(F.struct(*order).alias("o"), groups.alias("g")))
    dropped = None
    while not undecided.isEmpty():
        heads = cut(undecided.groupBy("g").agg(F.min("o").alias("o")))
        stays = heads.groupBy("o").agg(F.count("*").alias("n")).filter(F.col("n") == len(choices)).select("o")
        theirs = heads.join(stays, "o", "left_semi").select("g")
        gone = cut(undecided.join(theirs, "g", "left_semi").select("o").distinct().join(stays, "o", "left_anti"))
        dropped = gone if dropped is None else dropped.union(gone)
        undecided = cut(undecided.join(gone, "o", "left_anti").join(stays, "o", "left_anti"))
    return first if dropped is None else first.withColumn("o", F.struct(*order)).join(dropped, "o", "left_anti").drop("o")


def impute(df: DataFrame, strategy: str = "smart") -> DataFrame:
    """Missing values filled: numeric and boolean columns by median (mean for strategy "mean"), others by the most frequent value,
    the least of equals. "drop" leaves out rows with missing values; any other strategy is "smart". A column without values stays as it is."""
    df = normalise(df)
    if strategy == "drop":
        return df.na.drop("any")
    return df.withColumns({c: F.coalesce(F.col(c), v) for c, v in fill_values(df, strategy).items()})


def fill_values(df: DataFrame, strategy: str = "smart") -> dict[str, Column]:
    """The value that fills each column, for columns with missing values."""
    numeric = set(numeric_columns(df))
    some = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"m{i}") for i, c in enumerate(df.columns)]).first()
    need = [c for i, c in enumerate(df.columns) if some[f"m{i}"]]
    if not need:
        return {}
    mid = lambda c: (F.avg if strategy == "mean" else F.median)(F.col(c).cast("double"))
    aggs = {c: mid(c) for c in need if c in numeric}
    aggs |= {c: F.median(F.col(c).cast("int").cast("double")) for c in need if isinstance(df.schema[c].dataType, T.BooleanType)}
    aggs |= {c: F.mode(c, deterministic=True) for c in need if c not in aggs}
    row = df.agg(*[a.alias(f"f{i}") for i, a in enumerate(aggs.values())]).first()
    out = {}
    for i, c in enumerate(aggs):
        kind = df.schema[c].dataType
        if row[f"f{i}"] is None:
            continue
        if isinstance(kind, T.BooleanType):
            out[c] = F.lit(row[f"f{i}"] >= 0.5)
        elif isinstance(kind, T.IntegralType):
            out[c] = F.lit(row[f"f{i}"])  # the column becomes double, as a median may lie between two values
        else:
            out[c] = F.lit(row[f"f{i}"]).cast(kind)
    return out


def imputed_count(df: DataFrame, strategy: str = "smart") -> DataFrame:
    """imputed: missing values met, also where nothing could be filled; for "drop", rows left out."""
    df = normalise(df)
    null = [F.col(c).isNull() for c in df.columns]
    if strategy == "drop":
        any_ = F.lit(False)
        for n in null:
            any_ = any_ | n
        return df.agg(F.count_if(any_).alias("imputed"))
    return df.agg(F.coalesce(F.sum(sum((n.cast("long") for n in null), F.lit(0).cast("long"))), F.lit(0)).alias("imputed"))


def clean(df: DataFrame, order: list[str] | None = None, dedup: bool = True, subset: list[str] | None = None, fuzzy: bool = False, names: bool = True, fill: bool = True, strategy: str = "smart") -> DataFrame:
    """standardize, then dedup, then impute. subset and order name the standardised columns."""
    out = standardize(df) if names else df
    if dedup:
        out = dedup_fuzzy(out, order or out.columns, subset) if fuzzy else dedup_exact(out, subset, order)
    return impute(out, strategy) if fill else out


def clean_report(df: DataFrame, order: list[str] | None = None, subset: list[str] | None = None, fuzzy: bool = False, strategy: str = "smart") -> DataFrame:
    """rows_before, rows_after, duplicates_removed, values_imputed, columns_renamed of the same cleaning."""
    named = standardize(df)
    unique = dedup_fuzzy(named, order or named.columns, subset) if fuzzy else dedup_exact(named, subset, order)
    counts = lambda d, n: d.agg(F.count("*").alias(n))
    out = counts(df, "rows_before").join(F.broadcast(counts(unique, "rows_deduplicated"))).join(F.broadcast(counts(impute(unique, strategy), "rows_after"))).join(F.broadcast(imputed_count(unique, strategy)))  # one row each
    renamed = sum(a != b for a, b in zip(df.columns, named.columns, strict=True))
    return out.select("rows_before", "rows_after", (F.col("rows_before") - F.col("rows_deduplicated")).alias("duplicates_removed"), F.col("imputed").alias("values_imputed"), F.lit(renamed).cast("long").alias("columns_renamed"))
