"""Seeded synthetic tables, built where they are needed from row numbers and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHANNELS = ("Google Ads", "Facebook", "Email", "Organic", "Referral", "LinkedIn")
CATEGORIES = ("Electronics", "Clothing", "Home", "Books", "Sports")
REGIONS = ("North", "South", "East", "West")
DEPARTMENTS = ("Engineering", "Sales", "Marketing", "HR", "Finance")


def _unit(seed: int, salt: int, *more: str) -> Column:
    """Uniform in [0, 1) from the row number."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt), *more), F.lit(1 << 40)) / float(1 << 40)


def _one_of(values: tuple, u: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * len(values)) + 1).cast("int"))


def _normal(seed: int, salt: int) -> Column:
    return F.sqrt(-2 * F.ln(1 - _unit(seed, salt))) * F.cos(2 * 3.141592653589793 * _unit(seed, salt + 1))


def ecommerce(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """Orders with a rating missing in about three of ten rows."""
    u = lambda k: _unit(seed, k)
    base = spark.range(n).select("id", _one_of(CATEGORIES, u(1)).alias("category"), (F.floor(u(2) * 5) + 1).cast("long").alias("quantity"), F.round(5 + u(3) * 495, 2).alias("unit_price"), (F.floor(u(4) * 5) * 5).cast("double").alias("discount_pct"))
    revenue = F.round(F.col("quantity") * F.col("unit_price") * (1 - F.col("discount_pct") / 100), 2)
    return base.select(F.format_string("ORD-%05d", F.col("id") + 1).alias("order_id"), F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.floor(u(5) * 365)).cast("int")), "yyyy-MM-dd").alias("date"), F.format_string("CUST-%04d", F.floor(u(6) * 300)).alias("customer_id"), "category", F.concat_ws(" ", "category", F.lit("item"), (F.floor(u(7) * 20)).cast("string")).alias("product_name"), "quantity", "unit_price", "discount_pct", revenue.alias("revenue"), _one_of(REGIONS, u(8)).alias("region"), _one_of(CHANNELS, u(9)).alias("channel"), _one_of(("Card", "PayPal", "Transfer"), u(10)).alias("payment_method"), (u(11) < 0.08).cast("long").alias("returned"), F.when(u(12) >= 0.3, F.round(1 + u(13) * 4, 1)).alias("customer_rating"))


def touchpoints(spark: SparkSession, users: int = 200, seed: int = 42) -> DataFrame:
    """One to eight touches for each user, and whether the user converted."""
    u = lambda k, *more: _unit(seed, k, *more)
    each = spark.range(users).withColumn("touch", F.explode(F.sequence(F.lit(1), (F.floor(_unit(seed, 1) * 8) + 1).cast("int"))))
    at = F.timestamp_seconds(F.lit(1704067200) + F.floor(u(2) * 60) * 86400 + F.col("touch") * 43200)
    return each.select(F.format_string("USER-%04d", "id").alias("user_id"), _one_of(CHANNELS, u(3, "touch")).alias("channel"), F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("timestamp"), F.concat(F.lit("campaign_"), (F.floor(u(4, "touch") * 5)).cast("string")).alias("campaign"), F.round(u(5, "touch") * 20, 2).alias("spend"), (u(6) < 0.35).cast("long").alias("converted"))


def hr(spark: SparkSession, n: int = 500, seed: int = 42) -> DataFrame:
    """Employees, with attrition likelier for the dissatisfied and those with overtime."""
    u = lambda k: _unit(seed, k)
    base = spark.range(n).select("id", _one_of(DEPARTMENTS, u(1)).alias("department"), _one_of(("Bachelor", "Master", "PhD", "High School"), u(2)).alias("education"), F.floor(u(3) * 20).cast("long").alias("years_at_company"), (3000 + F.floor(u(4) * 9000)).cast("long").alias("monthly_salary"), (F.floor(u(5) * 5) + 1).cast("long").alias("performance_rating"), F.round(1 + u(6) * 4, 1).alias("job_satisfaction"), (u(7) < 0.3).cast("long").alias("overtime"))
    risk = 0.1 + 0.2 * F.col("overtime") + 0.1 * (F.col("job_satisfaction") < 2.5).cast("int")
    return base.select(F.format_string("EMP-%04d", F.col("id") + 1000).alias("employee_id"), *base.columns[1:], F.floor(u(8) * 40).cast("long").alias("distance_from_home_miles"), F.floor(u(9) * 8).cast("long").alias("num_companies_worked"), F.floor(u(10) * 80).cast("long").alias("training_hours_last_year"), (u(11) < risk).cast("long").alias("attrition"))


def sales(spark: SparkSession, days: int = 365, seed: int = 42) -> DataFrame:
    """Daily sales: a line, a yearly wave and noise."""
    trend = 100 + 0.3 * F.col("id")
    wave = 20 * F.sin(2 * 3.141592653589793 * F.col("id") / 365)
    return spark.range(days).select(F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("date"), F.round(trend + wave + 5 * _normal(seed, 1), 2).alias("sales"), F.round(trend, 2).alias("trend"), F.round(wave, 2).alias("seasonality"))


def classification(spark: SparkSession, n: int = 200, features: int = 5, informative: int = 3, classes: int = 2, seed: int = 42) -> DataFrame:
    """label, and f0 ... : the informative ones shifted by the label, the others noise."""
    rows = spark.range(n).withColumn("label", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(classes)).cast("double"))
    return rows.select("label", *[(_normal(seed, 10 + 2 * i) + (F.col("label") * 1.5 * (-1) ** i if i < informative else F.lit(0.0))).alias(f"f{i}") for i in range(features)])
