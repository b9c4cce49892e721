"""Marketing attribution: which channel gets the credit for a conversion.

Touchpoints have a user, a channel and a time; conversions are a table of users. The
semi-join to converted users comes first, so all that follows is about them only, and
one shuffle by user serves a model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismtab.functions.columns import as_timestamp, epoch_seconds, require

REQUIRED = ("user_id", "channel", "timestamp")
MODELS = ("first_touch", "last_touch", "linear", "time_decay")


def converted_touches(touchpoints: DataFrame, conversions: DataFrame) -> DataFrame:
    """Touchpoints of converted users; ValueError if a required column is missing."""
    require(touchpoints, REQUIRED)
    users = conversions.select("user_id").filter("user_id is not null").distinct()
    return touchpoints.join(users, "user_id", "left_semi")


def _single(touchpoints: DataFrame, conversions: DataFrame, last: bool, tie: str | None) -> DataFrame:
    touches = converted_touches(touchpoints, conversions).filter("channel is not null")
    order = F.struct(as_timestamp(touches, "timestamp"), *([F.col(tie)] if tie else []), F.col("channel"))
    pick = F.max_by if last else F.min_by
    per_user = touches.filter("timestamp is not null").groupBy("user_id").agg(pick("channel", order).alias("channel"))
    counts = per_user.groupBy("channel").agg(F.count("*").alias("conversions"))
    total = F.sum("conversions").over(Window.partitionBy())  # one row for each channel
    return counts.select("channel", "conversions", F.round(F.col("conversions") / total * 100, 2).alias("credit_pct"))


def first_touch(touchpoints: DataFrame, conversions: DataFrame, tie: str | None = None) -> DataFrame:
    """channel, conversions, credit_pct: each converted user counts for the first channel. tie: a column that orders equal times."""
    return _single(touchpoints, conversions, False, tie)


def last_touch(touchpoints: DataFrame, conversions: DataFrame, tie: str | None = None) -> DataFrame:
    """As first_touch, for the last channel, whether before or after the conversion."""
    return _single(touchpoints, conversions, True, tie)


def _shared(touches: DataFrame, weight: Column, conversions: DataFrame) -> DataFrame:
    """channel, credit, credit_pct: each user's weights shared out, the percentage of all conversions, also of users without touches."""
    user = Window.partitionBy("user_id")
    shares = touches.withColumn("weight", weight).withColumn("share", F.col("weight") / F.sum("weight").over(user))
    credits = shares.groupBy("channel").agg(F.sum("share").alias("credit"))
    n = conversions.filter("user_id is not null").agg(F.greatest(F.count_distinct("user_id"), F.lit(1)).alias("n"))  # one row
    return credits.join(F.broadcast(n)).select("channel", F.round("credit", 2).alias("credit"), F.round(F.col("credit") / F.col("n") * 100, 2).alias("credit_pct"))


def linear(touchpoints: DataFrame, conversions: DataFrame) -> DataFrame:
    """Every touch of a user gets the same share."""
    touches = converted_touches(touchpoints, conversions).select("user_id", "channel")
    # Touches are counted by user and channel first, so a user with very many touches is a few rows.
    return _shared(touches.groupBy("user_id", "channel").agg(F.count("*").alias("n")), F.col("n").cast("double"), conversions)


def time_decay(touchpoints: DataFrame, conversions: DataFrame, half_life_days: float = 7.0) -> DataFrame:
    """A touch's share halves with each half life before the user's last touch. Touches without a time are left out."""
    touches = converted_touches(touchpoints, conversions)
    seconds = epoch_seconds(as_timestamp(touches, "timestamp"))
    timed = touches.select("user_id", "channel", seconds.alias("at")).filter("at is not null")
    last = Window.partitionBy("user_id")
    aged = timed.withColumn("days", (F.max("at").over(last) - F.col("at")) / 86400.0)
    return _shared(aged, F.exp(F.lit(-0.6931471805599453 / half_life_days) * F.col("days")), conversions)


def all_models(touchpoints: DataFrame, conversions: DataFrame, half_life_days: float = 7.0, tie: str | None = None) -> DataFrame:
    """model, channel, credit, credit_pct of the four models."""
    parts = []
    for name, df in (
        ("first_touch", first_touch(touchpoints, conversions, tie)),
        ("last_touch", last_touch(touchpoints, conversions, tie)),
        ("linear", linear(touchpoints, conversions)),
        ("time_decay", time_decay(touchpoints, conversions, half_life_days)),
    ):
        credit = "conversions" if "conversions" in df.columns else "credit"
        parts.append(df.select(F.lit(name).alias("model"), "channel", F.col(credit).cast("double").alias("credit"), "credit_pct"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
