"""Quality of 0 to 1: completeness, uniqueness, consistency, validity against rules, and issues."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismtab.functions.columns import normalise
from prismtab.operators.profile import value_counts

Rule = Column | str | Callable[[object], bool]
WEIGHTS = (0.3, 0.2, 0.3, 0.2)


def rule_column(df: DataFrame, name: str, rule: Rule) -> Column:
    """A rule as a boolean column: a Column, an SQL expression over the column's name, or a Python function of one value."""
    if isinstance(rule, Column):
        return rule
    if isinstance(rule, str):
        return F.expr(rule)

    @F.pandas_udf("boolean")
    def check(values: pd.Series) -> pd.Series:
        return values.map(lambda v: False if v is None else bool(rule(v)))

    return check(F.col(name))


def value_kind(c: str) -> Column:
    """The kind of a text value: int, float, bool or str."""
    x = F.trim(F.col(c))
    return F.when(x.rlike(r"^[+-]?\d+$"), "int").when(x.rlike(r"^[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?$"), "float").when(F.lower(x).isin("true", "false"), "bool").otherwise("str")


def score_columns(df: DataFrame, rules: dict[str, list[Rule]] | None = None, weights: tuple[float, float, float, float] = WEIGHTS) -> DataFrame:
    """ordinal, column, completeness, uniqueness, consistency, validity, overall, each rounded to 6 places.

    Uniqueness is of non-null values, and 1 if there are none. Consistency is the share of the most frequent
    kind of value; a typed column has one kind. Validity is the share of non-null values that pass all rules,
    1 without rules or values. An empty table scores 1 throughout.
    """
    df, rules = normalise(df), rules or {}
    aggs, checked = [F.count("*").alias("rows")], df
    for i, c in enumerate(df.columns):
        text = isinstance(df.schema[c].dataType, T.StringType)
        aggs.append(F.count(c).alias(f"n{i}"))
        for kind in ("int", "float", "bool", "str"):
            aggs.append((F.count_if(F.col(c).isNotNull() & (value_kind(c) == kind)) if text else F.count(c) if kind == "str" else F.lit(0).cast("long")).alias(f"{kind}{i}"))
        ok = F.lit(True)
        for r in rules.get(c, []):
            ok = ok & F.coalesce(rule_column(df, c, r), F.lit(False))
        checked = checked.withColumn(f"ok__{i}", ok)
        aggs.append(F.count_if(F.col(c).isNotNull() & F.col(f"ok__{i}")).alias(f"ok{i}"))
    cells = [
        F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col("rows"), F.col(f"n{i}").alias("n"), F.greatest(*[F.col(f"{k}{i}") for k in ("int", "float", "bool", "str")]).alias("most"), F.col(f"ok{i}").alias("ok"))
        for i, c in enumerate(df.columns)
    ]
    base = checked.agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*")
    distinct = value_counts(df, df.columns).groupBy("column").agg(F.count("*").alias("d"))
    share = lambda a, b: F.round(F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(1.0), 6)
    parts = base.join(F.broadcast(distinct), "column", "left").select(
        "ordinal", "column", share(F.col("n"), F.col("rows")).alias("completeness"), share(F.coalesce("d", F.lit(0)), F.col("n")).alias("uniqueness"), share(F.col("most"), F.col("n")).alias("consistency"), share(F.col("ok"), F.col("n")).alias("validity")
    )
    total = sum((F.col(c) * w for c, w in zip(("completeness", "uniqueness", "consistency", "validity"), weights, strict=True)), F.lit(0.0))
    return parts.withColumn("overall", F.round(total / sum(weights), 6))


def score_table(df: DataFrame, rules: dict[str, list[Rule]] | None = None) -> DataFrame:
    """overall_score, row_count, issues: the mean of the columns' scores and what is wrong with them. An empty table scores 1, with an issue that says so."""
    low = [("completeness", 0.9), ("uniqueness", 0.5), ("consistency", 0.9)]
    scored = score_columns(df, rules)
    issue = F.array_compact(F.array(*[F.when(F.col(k) < at, F.concat(F.lit("Column '"), F.col("column"), F.lit(f"' has low {k}: "), F.format_number(F.col(k) * 100, 2), F.lit("%"))) for k, at in low]))
    summed = scored.agg(F.round(F.avg("overall"), 6).alias("overall_score"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", issue.alias("i")))), lambda x: x["i"])).alias("issues"))
    both = summed.join(F.broadcast(df.agg(F.count("*").alias("row_count"))))  # one row each
    empty = F.col("row_count") == 0
    return both.select(F.when(empty, 1.0).otherwise(F.col("overall_score")).alias("overall_score"), "row_count", F.when(empty, F.array(F.lit("The table is empty"))).otherwise(F.col("issues")).alias("issues"))
