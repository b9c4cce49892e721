"""Document fingerprints by consistent weighted sampling, in DataFrame operations only.

A document is its words, weighted by how often they occur. For each of SAMPLES
positions, each word draws r and c from Gamma(2, 1) and b from [0, 1), all from a
hash of word and position; with t = floor(ln w / r + b), the word with the least
ln c - r (t - b + 1) is the sample, and the position holds a hash of (word, t). Two
documents' positions are equal with a probability of their generalised Jaccard
similarity, the sum of the lesser weights over the sum of the greater ones.

(rk, word) rows are dealt once by document; counting, sampling and gathering then
all happen where they are, so nothing is shuffled for a sample.
"""

from __future__ import annotations

import math
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismtab.llm.common import cut, row_key, table

SAMPLES = 32
#: Positions that one row samples; SAMPLES is a multiple. With more than 2 the generated code is too long to be compiled.
LANES = 1
#: Cells of the quantile tables, and those in which ln c is worked out.
CELLS, LOW = 4096, 16
#: Stretches of ids that are put in order apart have about so many rows, or there are MOST of them.
STRETCH, MOST = 400, 2048
_SPLIT = r"[\x20\x09-\x0D]+"


def _gamma_quantile(q: float) -> float:
    """The quantile of Gamma(2, 1): F(c) = 1 - (1 + c) exp(-c)."""
    lo, hi = 0.0, 60.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < q else (lo, mid)
    return (lo + hi) / 2


@cache
def _tables() -> tuple[str, str]:
    """Gamma(2, 1) and its logarithm at CELLS + 1 quantiles, as SQL arrays; the first and last are those of a quarter of a cell."""
    at = [max(0.25, min(CELLS - 0.25, i)) / CELLS for i in range(CELLS + 1)]
    values = [_gamma_quantile(q) for q in at]
    array = lambda xs: "cast(split('" + ",".join(f"{x:.7g}" for x in xs) + "', ',') as array<double>)"
    return array(values), array([math.log(x) for x in values])


def samples(texts: DataFrame, keys: list[str], n: int = SAMPLES) -> DataFrame:
    """keys, fingerprint (n hashes of 32 bits, in order) of each text that has words; partitioned by a subset of keys, nothing is shuffled.

    All draws of a word and position come from one 64-bit hash: 20 bits for r, 28 for c, 16 for b. r and ln c are read from
    tables of quantiles and interpolated; below LOW cells, where the least of many words is decided, ln c is worked out.
    A row samples LANES positions, so a text's samples are found by n / LANES lookups for each word.
    """
    words = texts.select(*keys, F.explode(F.split("text", _SPLIT)).alias("word")).filter("word <> ''")
    terms = words.groupBy(*keys, F.xxhash64("word").alias("h")).agg(F.count("*").alias("w"))
    lanes = range(LANES)
    rows = terms.select(*keys, "h", F.ln(F.col("w").cast("double")).alias("lw"), F.explode(F.sequence(F.lit(0), F.lit(n // LANES - 1))).alias("g"))
    rows = rows.selectExpr("*", *[f"xxhash64(h, g * {LANES} + {j}) as x{j}" for j in lanes])
    gamma, log_gamma = (F.expr(t) for t in _tables())
    bits = lambda j, shift, width: F.shiftrightunsigned(f"x{j}", shift).bitwiseAND(F.lit((1 << width) - 1)).cast("int")
    read = lambda table, i, f: table[i] + (table[i + 1] - table[i]) * f

    def draws(j: int) -> list[Column]:
        low = (F.shiftrightunsigned(f"x{j}", 20).bitwiseAND(F.lit((1 << 28) - 1)) + 0.5) / float(1 << 28)
        tail = 0.5 * F.ln(2.0 * low) + F.sqrt(2.0 * low) / 3.0
        cell = bits(j, 36, 12)
        c = F.when(cell < LOW, tail).otherwise(read(log_gamma, cell, (bits(j, 20, 16) + 0.5) / 65536.0))
        r = read(gamma, bits(j, 8, 12), (bits(j, 0, 8) + 0.5) / 256.0)
        return [r.alias(f"r{j}"), c.alias(f"c{j}"), ((bits(j, 48, 16) + 0.5) / 65536.0).alias(f"b{j}")]

    rows = rows.select(*keys, "g", "h", "lw", *[c for j in lanes for c in draws(j)])
    rows = rows.selectExpr(*keys, "g", "h", *[e for j in lanes for e in (f"r{j}", f"c{j}", f"b{j}", f"floor(lw / r{j} + b{j}) as t{j}")])
    rows = rows.selectExpr(*keys, "g", *[e for j in lanes for e in (f"xxhash64(h, t{j}) & 4294967295L as s{j}", f"c{j} - r{j} * (t{j} - b{j} + 1D) as a{j}")])
    least = rows.groupBy(*keys, "g").agg(*[F.min_by(f"s{j}", f"a{j}").alias(f"s{j}") for j in lanes])
    gathered = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("g", F.array(*[F.col(f"s{j}") for j in lanes]).alias("s")))).alias("z"))
    return gathered.select(*keys, F.flatten(F.col("z.s")).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal positions; texts without words are like each other and nothing else."""
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a).cast("double")
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(equal)


def following(rows: DataFrame) -> DataFrame:
    """rk, next_rk of rows (doc_id, rk), all different: the row after it, doc_id descending, null last; after the last comes the first.

    Rows are put in order within stretches of ids between quantiles, those without an id within stretches of rk. Where a
    stretch ends, the next one's first row follows; these are at most MOST + 256 rows, the only ones the driver sees.
    All texts of one id are in one stretch.
    """
    n = rows.count()
    k = max(1, min(MOST, n // STRETCH))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 20 * MOST)).first()[0] or []
    cuts = sorted(set(cuts))
    splits = F.array(*[F.lit(c).cast("long") for c in cuts]) if cuts else F.array().cast("array<long>")
    # Rows without an id are ordered by rk alone, so 256 stretches of rk do for any number of them.
    stretch = F.when(F.col("doc_id").isNull(), F.lit(-129) - F.shiftright("rk", 56).cast("int")).otherwise(F.size(F.filter(splits, lambda s: s <= F.col("doc_id"))))
    order = Window.partitionBy("stretch").orderBy(F.col("doc_id").desc_nulls_last(), "rk")
    placed = cut(rows.withColumn("stretch", stretch).select("rk", "stretch", F.lead("rk").over(order).alias("next_rk"), F.row_number().over(order).alias("i")))
    heads = sorted(((r["stretch"], r["rk"]) for r in placed.filter("i = 1").select("stretch", "rk").collect()), reverse=True)
    edges = [(s, heads[(j + 1) % len(heads)][1]) for j, (s, _) in enumerate(heads)]
    after = rows.sparkSession.createDataFrame(edges or [(0, 0)], "stretch int, first_rk long")
    return placed.join(F.broadcast(after), "stretch").select("rk", F.coalesce("next_rk", "first_rk").alias("next_rk"))


def fingerprints(docs: DataFrame, n: int = SAMPLES) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third (floor of n_chars / 3 code points) replaced by as many of the
    first code points of the next document, or all it has; next is by descending doc_id, then row key, null ids
    last, and the first after the last. Rows equal in doc_id and text have one place in that order, and each
    is returned. Null text counts as empty; a text without words has an empty fingerprint. Other columns are not
    read; an empty table gives none. Words are runs of other bytes than ASCII white space, as they are.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
    narrow = cut(whole.select("rk", "doc_id", F.char_length("text").cast("long").alias("n_chars")))
    rows = narrow.distinct()
    repeated = narrow.count() != rows.count()
    order = cut(following(rows.select("doc_id", "rk")).join(rows.select("rk", "n_chars"), "rk"))
    once = whole.select("rk", "text").dropDuplicates(["rk"]) if repeated else whole.select("rk", "text")
    wants = order.select(F.col("next_rk").alias("rk"), F.col("rk").alias("to"), F.floor(F.col("n_chars") / 3).cast("int").alias("third"))
    heads = once.join(wants.hint("shuffle_hash"), "rk").select(F.col("to").alias("rk"), F.substring("text", F.lit(1), F.col("third")).alias("head"), "third")
    both = once.join(heads.hint("shuffle_hash"), "rk").select("rk", "text", F.concat(F.substring("text", F.lit(1), F.char_length("text") - F.col("third")), "head").alias("edited"))
    texts = both.select("rk", F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("text")))).alias("v")).select("rk", "v.which", "v.text")
    drawn = samples(texts, ["rk", "which"], n)
    pair = drawn.groupBy("rk").agg(F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("f"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("e"))
    # One job for samples and digests, so that both read one shuffle of the texts.
    pair = cut(both.select("rk", F.sha2("edited", 256).alias("edited_sha256")).join(pair, "rk", "left"))
    following_f = order.select("rk", "next_rk").join(pair.select(F.col("rk").alias("next_rk"), F.col("f").alias("g")), "next_rk").select("rk", "g")
    joined = narrow.join(pair, "rk").join(following_f, "rk")
    text = lambda c: F.coalesce(F.array_join(F.transform(c, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), ""), F.lit(""))
    return joined.select("doc_id", "n_chars", "edited_sha256", text("f").alias("fingerprint"), text("e").alias("edited_fingerprint"), likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
