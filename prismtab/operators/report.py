"""Chart data and reports, from a profile and the table."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismtab.functions.columns import as_timestamp, normalise
from prismtab.operators.profile import correlations, duplicate_rows, memory_mb, profile

CATEGORIES, TOP, PIE, BINS, SCATTER = ("categorical", "categorical_numeric", "boolean"), 15, 8, 50, 5


def chart_type(kind: Column, unique: Column) -> Column:
    """pie up to 8 categories, else bar; histogram for numbers; line for times; bar for the rest."""
    return F.when(kind.isin(*CATEGORIES), F.when(unique <= PIE, "pie").otherwise("bar")).when(kind.isin("integer", "float"), "histogram").when(kind.isin("datetime", "datetime_string"), "line").otherwise("bar")


def value_chart(df: DataFrame, column: str, n: int = TOP) -> DataFrame:
    """label, n: the most frequent values, ties by value."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("label")).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), "label").limit(n)


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """bin, low, high, n: equal widths, at most as many bins as distinct values; the last bin holds the greatest value."""
    x = F.col(column).cast("double")
    r = normalise(df).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count_distinct(x).alias("d")).first()
    if not r["d"]:
        return df.sparkSession.createDataFrame([], "bin int, low double, high double, n long")
    k = min(bins, r["d"])
    width = (r["hi"] - r["lo"]) / k or 1.0
    at = F.least(F.floor((x - r["lo"]) / width), F.lit(k - 1)).cast("int")
    return normalise(df).filter(x.isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).select("bin", (r["lo"] + F.col("bin") * width).alias("low"), (r["lo"] + (F.col("bin") + 1) * width).alias("high"), "n")


def timeline(df: DataFrame, column: str) -> DataFrame:
    """day, n, in order."""
    day = F.to_date(as_timestamp(df, column))
    return df.filter(day.isNotNull()).groupBy(day.alias("day")).agg(F.count("*").alias("n")).orderBy("day")


@dataclass
class Chart:
    """What to draw: a title, a kind, and the data as a table."""

    title: str
    kind: str
    data: DataFrame


def distribution_chart(df: DataFrame, column: str, kind: str) -> Chart:
    if kind in CATEGORIES:
        return Chart(f"{column} Distribution", "categorical", value_chart(df, column))
    if kind in ("integer", "float"):
        return Chart(f"{column} Distribution", "histogram", histogram(df, column))
    if kind in ("datetime", "datetime_string"):
        return Chart(f"{column} Over Time", "line", timeline(df, column))
    return Chart(f"{column} Top Values", "bar", value_chart(df, column))


def heatmap(df: DataFrame) -> Chart | None:
    """Correlations in long form, both triangles; None for fewer than two numeric columns."""
    r = correlations(df)
    if r.isEmpty():
        return None
    both = r.union(r.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))
    return Chart("Feature Correlations", "heatmap", both)


def scatter(df: DataFrame, columns: list[str], most: int = SCATTER) -> Chart | None:
    """The first columns' values of all rows; None for fewer than two columns."""
    if len(columns) < 2:
        return None
    return Chart("Scatter Matrix", "scatter_matrix", df.select(*columns[:most]))


def dashboard(df: DataFrame, profiled: DataFrame | None = None) -> list[Chart]:
    """A chart for each column but text with more than 50 distinct values, then heat map and scatter."""
    rows = (profiled if profiled is not None else profile(df)).orderBy("ordinal").collect()  # a row for each column
    charts = [distribution_chart(df, r["column"], r["type"]) for r in rows if not (r["type"] in ("text", "string") and r["unique_count"] > 50)]
    numeric = [r["column"] for r in rows if r["type"] in ("integer", "float")]
    return charts + [c for c in (heatmap(df), scatter(df, numeric)) if c]


def chart_plan(profiled: DataFrame) -> DataFrame:
    """column, chart: which chart each column gets, skipping text with many values."""
    shown = profiled.filter(~(F.col("type").isin("text", "string") & (F.col("unique_count") > 50)))
    return shown.select("column", chart_type(F.col("type"), F.col("unique_count")).alias("chart"))


def findings(profiled: DataFrame, duplicates: DataFrame) -> DataFrame:
    """ordinal, finding, amount, columns: much missing (over 20 %), outliers, duplicate rows, skewness beyond 1; only those there are."""
    named = lambda cond: F.array_join(F.sort_array(F.collect_list(F.when(cond, F.col("column")))), ", ")
    one = profiled.agg(
        F.count_if(F.col("null_pct") > 20).cast("long").alias("a0"), named(F.col("null_pct") > 20).alias("c0"),
        F.coalesce(F.sum("outlier_count"), F.lit(0)).cast("long").alias("a1"), named(F.col("outlier_count") > 0).alias("c1"),
        F.count_if(F.abs("skewness") > 1).cast("long").alias("a3"), named(F.abs("skewness") > 1).alias("c3"),
    )
    both = one.join(F.broadcast(duplicates.select(F.col("duplicates").alias("a2"), F.lit("").alias("c2"))))  # one row each
    names = ("high_missing", "outliers", "duplicate_rows", "skewed")
    cells = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(n).alias("finding"), F.col(f"a{i}").alias("amount"), F.col(f"c{i}").alias("columns")) for i, n in enumerate(names)])
    return both.select(F.explode(cells).alias("f")).select("f.*").filter("amount > 0")


@dataclass
class Section:
    title: str
    content: str
    chart: Chart | None = None


@dataclass
class Report:
    title: str
    generated_at: str
    sections: list[Section] = field(default_factory=list)

    def markdown(self) -> str:
        lines = [f"# {self.title}", f"*Generated: {self.generated_at}*", ""]
        for s in self.sections:
            lines += [f"## {s.title}", s.content, ""]
        return "\n".join(lines)


def _grid(head: list[str], rows: list[list]) -> str:
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(head), line(["---"] * len(head)), *map(line, rows)])


def report(df: DataFrame, title: str = "Data Analysis Report", charts: list[Chart] = (), more: list[Section] = ()) -> Report:
    """Overview, findings, charts' titles and sections of the caller's, as text that fits on the driver: a line for each column."""
    p = profile(df)
    rows = p.orderBy("ordinal").collect()  # a row for each column
    dup = duplicate_rows(df)
    n_dup, mb = dup.first()[0], memory_mb(df).first()[0]
    overview = [f"**Rows**: {rows[0]['rows'] if rows else 0:,}", f"**Columns**: {len(rows)}", f"**Duplicate rows**: {n_dup:,}", f"**Memory**: {mb} MB", ""]
    overview.append(_grid(["Column", "Type", "Non-null", "Null %", "Unique", "Outliers"], [[r["column"], r["type"], f"{r['non_null_count']:,}", r["null_pct"], f"{r['unique_count']:,}", r["outlier_count"]] for r in rows]))
    numeric = [r for r in rows if r["mean"] is not None]
    if numeric:
        overview += ["", "### Numeric Summary", _grid(["Column", "Mean", "Median", "Std", "Min", "Max", "Skewness"], [[r[k] for k in ("column", "mean", "median", "std", "min", "max", "skewness")] for r in numeric])]
    out = Report(title, datetime.now(UTC).strftime("%Y-%m-%d %H:%M UTC"), [Section("Data Overview", "\n".join(overview))])
    words = {"high_missing": "High missing values", "outliers": "Outliers", "duplicate_rows": "Duplicate rows", "skewed": "Skewed distributions"}
    found = [f"- **{words[r['finding']]}**: {r['amount']}" + (f" ({r['columns']})" if r["columns"] else "") for r in findings(p, dup).orderBy("ordinal").collect()]
    if found:
        out.sections.append(Section("Key Findings", "\n".join(found)))
    out.sections += [Section(c.title, "", c) for c in charts]
    out.sections += list(more)
    return out
