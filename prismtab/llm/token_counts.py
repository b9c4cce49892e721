"""Exact token counts for every context limit, from the histogram of encoded lengths.

Documents are counted by length; sums over the lengths from one on upwards then
answer, for each limit, how many documents are longer, how many tokens there are
in all, how many are left when longer documents are cut at the limit, and which
share of the documents fits. Between two lengths that occur, the answers follow
from the row below, so the rows are exact for every limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismtab.llm.common import small_batches, steps, table, texts

_LOADED: dict = {}


def encoding(path: str):
    if path not in _LOADED:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def lengths(docs: DataFrame, path: str) -> DataFrame:
    """One row `length` per document; null and empty texts have length 0."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(path)
        for batch in batches:
            for part in steps(batch, "text"):
                yield pa.record_batch([pa.array([len(e.encode_ordinary(x)) for x in texts(part.column(0))], pa.int64())], ["length"])

    return docs.select("text").mapInArrow(work, "length long")


def histogram(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("length").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length that occurs, taken as context limit: the exact totals.

    Rows: limit, n_docs (of this length), n_fit (not longer), n_longer, tokens (in all documents),
    tokens_fit (in those not longer), tokens_truncated (each cut at the limit), share_fit. The window
    without a key sees one row for each different length, not for each document; an empty table gives no rows.
    """
    upto = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.orderBy("length").rowsBetween(1, Window.unboundedFollowing)
    everything = Window.orderBy("length").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = F.col("length") * F.col("n_docs")
    longer = F.coalesce(F.sum("n_docs").over(after), F.lit(0))
    return hist.select(F.col("length").alias("limit"), "n_docs", F.sum("n_docs").over(upto).alias("n_fit"), longer.alias("n_longer"), F.sum(t).over(everything).alias("tokens"), F.sum(t).over(upto).alias("tokens_fit"), (F.sum(t).over(upto) + longer * F.col("length")).alias("tokens_truncated"), (F.sum("n_docs").over(upto) / F.sum("n_docs").over(everything)).alias("share_fit"))


def quantiles(limits: DataFrame, at: list[float]) -> DataFrame:
    """The least length that at least the share q of all documents does not exceed, for each q in at."""
    return limits.select(F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.when(F.col("share_fit") >= q, F.col("limit")).alias("x")) for q in at])).alias("s")).groupBy(F.col("s.q").alias("q")).agg(F.min("s.x").alias("length"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return limits(histogram(lengths(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))))
