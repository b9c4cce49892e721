"""Feature engineering: scaling, encoding, products, time parts, bins, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.columns import as_timestamp, normalise, numeric_columns, string_columns
from prismtab.functions.mutual_info import mutual_information

#: Distinct categories that one-hot columns are made of at most.
MOST_CATEGORIES = 10_000


def _scalers() -> dict:
    """How each method centres and divides; a divisor of 0 counts as 1."""
    return {
        "standard": lambda x: (F.avg(x), F.stddev_pop(x)),
        "minmax": lambda x: (F.min(x), F.max(x) - F.min(x)),
        "robust": lambda x: (F.percentile(x, F.lit(0.5)), F.percentile(x, F.lit(0.75)) - F.percentile(x, F.lit(0.25))),
    }


SCALERS = _scalers()


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    """df with {column}_scaled; the statistics are one row, joined to each."""
    if method not in SCALERS:
        raise ValueError(f"unknown method {method!r}")
    df = normalise(df)
    aggs = [a.alias(f"{n}__{i}") for i, c in enumerate(columns) for a, n in zip(SCALERS[method](F.col(c).cast("double")), ("center", "width"), strict=True)]
    joined = df.join(F.broadcast(df.agg(*aggs)))
    width = lambda i: F.when(F.col(f"width__{i}") == 0, 1.0).otherwise(F.col(f"width__{i}"))
    return joined.select(*df.columns, *[((F.col(c).cast("double") - F.col(f"center__{i}")) / width(i)).alias(f"{c}_scaled") for i, c in enumerate(columns)])


def onehot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by {column}_{value} of 0 and 1, sorted by value, all 0 for null. ValueError beyond MOST_CATEGORIES values."""
    new: list[Column] = []
    for c in columns:
        values = [r[0] for r in df.select(c).filter(F.col(c).isNotNull()).distinct().limit(MOST_CATEGORIES + 1).collect()]
        if len(values) > MOST_CATEGORIES:
            raise ValueError(f"{c!r} has more than {MOST_CATEGORIES} values")
        new += [F.coalesce((F.col(c) == v).cast("int"), F.lit(0)).alias(f"{c}_{v}") for v in sorted(values)]
    return df.select(*[x for x in df.columns if x not in columns], *new)


def ordinal(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """df with {column}_ordinal: the value's place in order, NULL for others."""
    at = F.array_position(F.array(*[F.lit(v) for v in order]), F.col(column))
    return df.withColumn(f"{column}_ordinal", F.when(at > 0, at - 1))


def polynomial(df: DataFrame, columns: list[str], degree: int = 2) -> DataFrame:
    """df with {c}_pow2 ... {c}_pow{degree}, then the product of each pair."""
    powers = {f"{c}_pow{d}": F.pow(F.col(c).cast("double"), F.lit(float(d))) for c in columns for d in range(2, degree + 1)}
    return interactions(df.withColumns(powers) if powers else df, columns)


def interactions(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with {a}_x_{b} for each pair, as double."""
    pairs = {f"{a}_x_{b}": F.col(a).cast("double") * F.col(b).cast("double") for i, a in enumerate(columns) for b in columns[i + 1 :]}
    return df.withColumns(pairs) if pairs else df


def auto_engineer(df: DataFrame) -> DataFrame:
    """All numeric columns scaled, all text columns one-hot, and the pairwise products of the first three numeric columns."""
    numeric, text = numeric_columns(df), string_columns(df)
    out = scale(df, numeric) if numeric else df
    out = onehot(out, text) if text else out
    return interactions(out, numeric[:3]) if len(numeric) > 1 else out


def select_features(df: DataFrame, target: str, method: str = "variance", threshold: float | None = None) -> DataFrame:
    """ordinal, feature, score, selected for each numeric column but target.

    variance (0.01): population variance above the threshold; score is the sample variance.
    correlation (0.9): a column goes if its absolute correlation with any earlier one is above the threshold; score is its
    correlation with the first. mutual_info (0.01): estimated from the three nearest neighbours; score at or above it stays.
    """
    df = normalise(df)
    columns = [c for c in numeric_columns(df) if c != target]
    if method == "variance":
        limit = 0.01 if threshold is None else threshold
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for f, n in ((F.var_pop, "p"), (F.var_samp, "s"))])
        cells = [F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("feature"), F.col(f"s{i}").alias("score"), (F.col(f"p{i}") > limit).alias("selected")) for i, c in enumerate(columns)]
        return row.select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    if method == "correlation":
        from prismtab.operators.profile import correlations

        limit = 0.9 if threshold is None else threshold
        r = correlations(df, columns)
        places = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
        first = r.filter(F.col("a") == columns[0]).select(places[F.col("b")].alias("ordinal"), F.col("b").alias("feature"), "r")
        dropped = r.filter((F.col("a") != F.col("b")) & (F.abs("r") > limit)).groupBy(F.col("b").alias("feature")).agg(F.lit(True).alias("dropped"))
        return first.join(F.broadcast(dropped), "feature", "left").select("ordinal", "feature", F.coalesce("r", F.lit(0.0)).alias("score"), F.coalesce(~F.col("dropped"), F.lit(True)).alias("selected"))
    if method == "mutual_info":
        limit = 0.01 if threshold is None else threshold
        scores = mutual_information(df, columns, target)
        return scores.withColumn("selected", F.col("score") >= limit)
    raise ValueError(f"unknown method {method!r}")


def time_parts(df: DataFrame, column: str) -> DataFrame:
    """df with day_of_week (Monday 0), month, quarter, year and is_weekend of column, and hour if any row's isn't 0. Without the column, df as it is."""
    if column not in df.columns:
        return df
    at = as_timestamp(df, column)
    n = lambda part: f"{column}_{part}"
    parts = {n("day_of_week"): F.weekday(at), n("month"): F.month(at), n("quarter"): F.quarter(at), n("year"): F.year(at), n("is_weekend"): (F.weekday(at) >= 5).cast("int")}
    if df.agg(F.max(F.hour(at))).first()[0]:
        parts[n("hour")] = F.hour(at)
    return df.withColumns(parts)


def bin_numeric(df: DataFrame, column: str, n: int = 5, method: str = "equal_width") -> DataFrame:
    """df with {column}_binned, 0 to n - 1. Bins are closed on the right, the first on both sides. equal_frequency cuts at quantiles, equal ones once. Without the column, df as it is."""
    if column not in df.columns:
        return df
    df = normalise(df)
    x = F.col(column).cast("double")
    if method == "equal_width":
        lo, hi = df.agg(F.min(x), F.max(x)).first()
        if lo is None:
            return df.withColumn(f"{column}_binned", F.lit(None).cast("int"))
        if lo == hi:  # the interval is widened by a thousandth of the value on both sides
            lo, hi = (lo - 0.001 * abs(lo), hi + 0.001 * abs(hi)) if lo else (-0.001, 0.001)
        edges = [lo + (hi - lo) * i / n for i in range(n + 1)]
    elif method == "equal_frequency":
        found = df.agg(F.percentile(x, [i / n for i in range(n + 1)])).first()[0]
        edges = sorted(set(found or []))
    else:
        raise ValueError(f"unknown method {method!r}")
    code = F.lit(None).cast("int")
    for i in range(len(edges) - 1, 0, -1):
        code = F.when(x <= edges[i] if i < len(edges) - 1 else x.isNotNull(), i - 1).otherwise(code)
    return df.withColumn(f"{column}_binned", code)


def target_means(df: DataFrame, column: str, target: str) -> DataFrame:
    """category, mean: the target's mean for each value of column."""
    return normalise(df).filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("category")).agg(F.avg(F.col(target).cast("double")).alias("mean"))


def target_encode(df: DataFrame, column: str, target: str) -> DataFrame:
    """df with {column}_target_encoded: the target's mean for the value, the overall mean for null. Without either column, df as it is.

    The means are a table of their own, joined by value, so a frequent value is summed before it is shuffled.
    """
    if column not in df.columns or target not in df.columns:
        return df
    overall = normalise(df).agg(F.avg(F.col(target).cast("double"))).first()[0]
    means = target_means(df, column, target)
    joined = df.join(means, df[column] == means["category"], "left")
    return joined.select(*[df[c] for c in df.columns], F.coalesce("mean", F.lit(overall)).alias(f"{column}_target_encoded"))
