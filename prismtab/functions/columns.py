"""Column-level helpers: missing values, column pickers, rounding, safe arithmetic, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of numeric columns; booleans don't count."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def normalise(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in floating-point columns, so that there is one kind of missing value."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats}) if floats else df


def finite(c: Column | str) -> Column:
    """The value as double, NULL where it is missing, NaN or infinite."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0.0)))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def strip(c: Column | str) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s+", ""), r"\s+$", "")


def snake_case(name: str) -> str:
    """Lower case, blanks and hyphens to underscores, and only letters, digits and underscores."""
    return "".join(ch for ch in name.strip().lower().replace(" ", "_").replace("-", "_") if ch.isalnum() or ch == "_")


def distinct_names(names: list[str]) -> list[str]:
    """The names, later repeats with _2, _3 ... behind them."""
    seen: dict[str, int] = {}
    out = []
    for n in names:
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}_{seen[n]}")
    return out


#: Formats tried in turn where text may be a date or time.
DATE_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd.MM.yyyy", "MMM d, yyyy", "d MMM yyyy", "yyyy-MM-dd'T'HH:mm:ss")


def to_timestamp(c: Column | str) -> Column:
    """Text as timestamp by the first format that fits, else NULL. A bare number is no date unless it is a year."""
    x = F.col(c) if isinstance(c, str) else c
    tries = [F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS]
    iso = F.when(x.rlike(r"^\s*\d{4}(-\d|\s*$)"), x.try_cast("timestamp"))
    return F.coalesce(*tries, iso)


def as_timestamp(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    return to_timestamp(name) if isinstance(kind, T.StringType) else F.col(name).cast("timestamp")


def epoch_seconds(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)


def require(df: DataFrame, names: list[str] | set[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def long_form(df: DataFrame, columns: list[str], keep: list[str] = ()) -> DataFrame:
    """keep, column, value (double): one row for each cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.column", "cell.value")
