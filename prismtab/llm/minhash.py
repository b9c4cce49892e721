"""Near-duplicates: one-permutation hashing, optimal densification, bands and stars.

Equal shingle sets are one class and count once. A class's signature has one bin
for each of BANDS x ROWS parts of the hash space: the least shingle hash in it, or,
where the bin is empty, that of the first full bin in an order that depends on the
bin alone. Classes whose bins agree in a whole band share a bucket; each bucket
gives a star of edges to its least member, so it has fewer edges than members. The
stars' components are candidate groups: every pair that shares a bucket is in one.

Links are confirmed on the full sets. A group up to BLOCK members is a unit of work. In a larger
one, which may have come together by chance, every member is first compared with a few pivots; then the
members that are not linked to the best pivot are compared with the whole group in blocks, or, where that deals fewer
rows, with those that share a bucket with them. So the work of a chance group follows its buckets and not its square. Units return
spanning forests of their links, never all pairs, and components are closed over confirmed links alone.

All bands are dealt once, each with 64 bits of its class; only those that several classes have are kept. A class
is known by 128 bits of its set, a row by its doc_id and 64 bits of doc_id and text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prismtab.llm.common import cut, partitions, raw, release, row_key, small_batches, steps, table
from prismtab.llm.components import components
from prismtab.llm.words import LOWER, gram_hashes, mix, spans, turned, word_hashes

#: A pair at similarity 0.8 shares none of 48 bands of 6 bins with a probability of about 5e-7.
BANDS, ROWS = 48, 6
BLOCK, PIVOTS = 256, 16
#: Row keys of grouped classes that are broadcast at most, 8 bytes each; beyond them all texts are dealt.
FETCHED = 4_000_000
#: Shingles that one step of a unit's comparison works on.
COLUMNS = 8192

_BINS = BANDS * ROWS
_SECOND = np.uint64(0xA0761D6478BD642F)
_ORDER = np.stack([np.random.default_rng([7, i]).permutation(_BINS) for i in range(_BINS)])
_ROW_BASE = np.random.default_rng(11).integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The densified bins of a set of shingle hashes, sorted and not empty."""
    bins = ((hashes >> np.uint64(32)) * np.uint64(_BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out, full = np.zeros(_BINS, np.uint64), np.zeros(_BINS, bool)
    out[bins[first]], full[bins[first]] = hashes[first], True
    empty = np.flatnonzero(~full)
    at = 0
    while len(empty):  # in steps, as the first few tries mostly find a full bin
        tries = _ORDER[empty, at : at + 16]
        hit = full[tries]
        found = hit.any(1)
        out[empty[found]] = out[tries[found, hit[found].argmax(1)]]
        empty, at = empty[~found], at + 16
    return out


def bands(sig: np.ndarray) -> np.ndarray:
    return mix((sig.reshape(BANDS, ROWS) * _ROW_BASE).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_sets(col: pa.Array, shingle: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: n words in a row, or all words if there are fewer, or nothing."""
    body, offsets = raw(col)
    body = LOWER[body]
    starts, ends, row = spans(body, offsets)
    words = word_hashes(body, starts, ends)
    grams = gram_hashes(words, shingle)
    first = np.searchsorted(row, np.arange(len(col) + 1)).tolist()
    out = []
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= shingle:
            out.append(np.unique(grams[a : b - shingle + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else words[:0])
    return out


def fingerprinted(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, rk, n_shingles, cid (the class, 16 bytes), bands: null where this task has met the class before, or without shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[bytes] = set()
        for batch in batches:
            for some in steps(batch, "text"):
                n, cid, keys = [], [], []
                for s in shingle_sets(some.column(2), shingle):
                    n.append(len(s))
                    if not len(s):
                        cid.append(None), keys.append(None)
                        continue
                    c = np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s)), mix(turned(s) ^ _SECOND).sum(dtype=np.uint64)]).tobytes()
                    cid.append(c)
                    if c in met:
                        keys.append(None)
                        continue
                    if len(met) > 1_000_000:
                        met.clear()
                    met.add(c)
                    keys.append(bands(signature(s)).astype(np.int64))
                yield pa.record_batch([some.column(0), some.column(1), pa.array(n, pa.int64()), pa.array(cid, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "rk", "n_shingles", "cid", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key("doc_id", "text").alias("rk"), "text").mapInArrow(work, "doc_id long, rk long, n_shingles long, cid binary, bands array<long>")


def _units(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[list[tuple]]:
    """The rows of each unit; they come sorted by unit."""
    key, rows = None, []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[:n_keys] != key:
                if rows:
                    yield rows
                key, rows = r[:n_keys], []
            rows.append(r[n_keys:])
    if rows:
        yield rows


def linked(left: list[np.ndarray], right: list[np.ndarray], least: float) -> np.ndarray:
    """Which sets of the left are similar to which of the right, by exact intersections."""
    sizes = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    every = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(sizes))
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    fresh = np.diff(every, prepend=every[:1] ^ np.uint64(1)) != 0
    column = np.cumsum(fresh) - 1
    shared = np.bincount(column)[column] > 1  # others can't be in an intersection
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.diff(column, prepend=-1) != 0) - 1
    common = np.zeros((len(left), len(right)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, (at, at + COLUMNS))
        m = np.zeros((len(left) + len(right), COLUMNS), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m[: len(left)] @ m[len(left) :].T
    union = sizes[0][:, None] + sizes[1][None, :] - common
    return common * 100 >= union * round(least * 100)


def _forest(left: list[int], right: list[int], links: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what the links connect, fewer than there are members."""
    parent = {x: x for x in (*left, *right)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(links), strict=True):
        a, b = root(left[i]), root(right[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((left[i], right[j]))
    return out


def _compared(rows: DataFrame, keys: list[str], least: float, found: Callable) -> DataFrame:
    """Each unit's links: rows have the unit's keys, side (0 left, 1 right, 2 both), node and shingles."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v = [], []
        for unit in _units(batches, len(keys) + 1):
            sides = [[(n, np.frombuffer(s, np.uint64)) for side, n, s in unit if side in (k, 2)] for k in (0, 1)]
            if sides[0] and sides[1]:
                names = [[x[0] for x in s] for s in sides]
                for a, b in found(*names, linked(*[[x[1] for x in s] for s in sides], least)):
                    u.append(a), v.append(b)
            if len(u) > 8192:
                yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        yield pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    n = partitions(rows.sparkSession)
    # Dealt by a column made here: were rows already dealt by the keys, as after a join, Spark would leave this exchange out and
    # then be free to deal them anew at run time, as nothing it knows of needs a unit's rows together.
    units = rows.select(F.xxhash64(*keys).alias("unit"), *keys, "side", "node", "shingles")
    return units.repartition(n, "unit").sortWithinPartitions("unit", *keys).mapInArrow(work, "u long, v long")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in steps(batch, "text"):
                yield pa.record_batch([*some.columns[:3], pa.array([s.tobytes() for s in shingle_sets(some.column(3), shingle)], pa.binary())], ["node", "gid", "size", "shingles"])

    return docs.select("node", "gid", "size", "text").mapInArrow(work, "node long, gid long, size long, shingles binary")


def _shared(marked: DataFrame, classes: DataFrame) -> DataFrame:
    """node, key: the bands of each class that another class has too."""
    tag = F.xxhash64("cid").alias("tag")
    of_key = Window.partitionBy("key")
    dealt = marked.filter("bands is not null").select(tag, F.explode("bands").alias("key"))
    several = dealt.select("key", "tag", F.min("tag").over(of_key).alias("least"), F.max("tag").over(of_key).alias("most")).filter("least <> most")
    return cut(several.join(classes.select(tag, "node"), "tag").select("node", "key").distinct())


def clustered(docs: DataFrame, shingle: int = 5, least: float = 0.8) -> DataFrame:
    """Every row's doc_id, n_shingles and component_id, the least doc_id that links reach, and rk, its row key.

    Documents are linked if their sets of `shingle` words in a row (lower-case A to Z; all words if there are
    fewer) have a Jaccard similarity of `least` or more. Texts without words, null texts and rows without a
    doc_id are linked with nothing; the latter's component_id is null. Rows of one doc_id count as one
    document: what is linked with one is linked with all. Other columns are not read; an empty table gives none.
    """
    spark = docs.sparkSession
    marked = cut(fingerprinted(docs, shingle))
    seen = cut(marked.drop("bands"))
    first = seen.filter("cid is not null and doc_id is not null").groupBy("cid").agg(F.min(F.struct("doc_id", "rk")).alias("first"))
    classes = cut(first.select("cid", F.col("first.doc_id").alias("node"), F.col("first.rk").alias("rk")))
    banded = _shared(marked, classes)
    del marked  # and with it the bands that no other class has
    release(spark)
    same_id = seen.filter("cid is not null and doc_id is not null").join(classes.select("cid", "node"), "cid").filter("node <> doc_id")
    buckets = cut(banded.groupBy("key").agg(F.min("node").alias("center"), F.max("node").alias("last"), F.count("*").alias("n")).filter("center <> last").select("key", "center", "n"))
    stars = banded.join(buckets, "key").filter("node <> center").select(F.col("center").alias("u"), F.col("node").alias("v")).distinct()
    release(spark)
    found = components(stars)
    groups = cut(found.select("node", F.col("root").alias("gid")).union(found.select(F.col("root").alias("node"), F.col("root").alias("gid"))).distinct())
    sizes = groups.groupBy("gid").agg(F.count("*").alias("size"))
    large = cut(sizes.filter(F.col("size") > BLOCK).select("gid"))
    # Class rows to fetch, with their sets: those in groups, once each.
    wanted = cut(classes.join(groups, "node").join(sizes, "gid").select("rk", "node", "gid", "size"))
    text = docs.select(F.col("doc_id").cast("long").alias("node"), row_key("doc_id", "text").alias("rk"), F.coalesce("text", F.lit("")).alias("text"))
    if wanted.count() <= FETCHED:  # only their texts are dealt, not all
        text = text.join(F.broadcast(wanted.select("rk").distinct()), "rk", "left_semi").select("node", "rk", "text")
    sets = cut(_sets(text.join(wanted.hint("shuffle_hash"), ["node", "rk"]).dropDuplicates(["node", "rk"]), shingle))
    release(spark)
    side = lambda k: F.lit(k).alias("side")
    small = sets.filter(F.col("size") <= BLOCK).select("gid", side(2), "node", "shingles")
    edges = _compared(small, ["gid"], least, _forest)
    if large.limit(1).count():
        edges = edges.union(_large(sets.filter(F.col("size") > BLOCK), large, least, banded, buckets, groups))
    # Rows of one doc_id with other sets stand together.
    edges = edges.union(same_id.select(F.col("node").alias("u"), F.col("doc_id").alias("v")).join(classes.select(F.col("node").alias("v")).distinct(), "v").select("u", "v"))
    roots = components(edges)
    mapped = cut(classes.join(roots, "node", "left").select("cid", F.coalesce("root", "node").alias("component_id")))
    own = seen.filter("cid is null or doc_id is null").select("doc_id", "rk", "n_shingles", F.col("doc_id").alias("component_id"))
    rest = seen.filter("cid is not null and doc_id is not null").select("doc_id", "rk", "n_shingles", "cid")
    return rest.join(mapped, "cid").select("doc_id", "rk", "n_shingles", "component_id").union(own)


def _large(sets: DataFrame, large: DataFrame, least: float, banded: DataFrame, buckets: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges within groups of more than BLOCK members. sets: of their members; large: their gid; banded: node, key; buckets: key, center, n (members); groups: node, gid."""
    block = F.expr("pmod(xxhash64(node), n_blocks)").cast("int")
    members = cut(sets.withColumn("n_blocks", F.ceil(F.col("size") / BLOCK)).withColumn("block", block))
    # Pivots: the first members of block 0 of each group, so at most PIVOTS for each group.
    ranked = members.filter("block = 0").select("gid", "node", "n_blocks", F.row_number().over(Window.partitionBy("gid").orderBy(F.xxhash64("node", F.lit(1)))).alias("r"))
    pivots = cut(ranked.filter(F.col("r") <= PIVOTS).join(members.select("node", "gid", "shingles"), ["gid", "node"]))
    to_blocks = pivots.select("gid", F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))).alias("block"), F.lit(0).alias("side"), "node", "shingles")
    with_pivots = to_blocks.union(members.select("gid", "block", F.lit(1).alias("side"), "node", "shingles"))
    pivoted = cut(_compared(with_pivots, ["gid", "block"], least, lambda left, right, m: [(left[i], right[j]) for i, j in zip(*np.nonzero(m), strict=True)]))
    counts = pivoted.groupBy("u").agg(F.count("*").alias("n")).join(pivots.select(F.col("node").alias("u"), "gid"), "u")
    best = cut(counts.groupBy("gid").agg(F.max(F.struct("n", "u")).alias("b")).select(F.col("b.u").alias("u")))
    settled = pivoted.join(best, "u", "left_semi").select(F.col("v").alias("node")).distinct()
    loose = cut(members.join(settled, "node", "left_anti"))
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    # The rest is compared block by block of the group, or bucket by bucket where that deals fewer rows, as in a group that came together by chance.
    of_buckets = buckets.join(groups.join(large, "gid"), F.col("center") == F.col("node")).groupBy("gid").agg(F.sum(F.col("n") * parts(F.col("n"))).alias("bucket_rows"))
    n_loose = loose.groupBy("gid").agg(F.count("*").alias("loose"), F.first("size").alias("size"), F.first("n_blocks").alias("n_blocks"))
    block_rows = parts(F.col("loose")) * F.col("size") + F.col("loose") * F.col("n_blocks")
    ways = cut(n_loose.join(of_buckets, "gid").select("gid", parts(F.col("loose")).alias("n_loose"), (F.col("bucket_rows") < block_rows).alias("by_bucket")))
    edges = _by_block(loose, members, ways.filter("not by_bucket"), least).union(pivoted)
    chosen = ways.filter("by_bucket").select("gid")
    if chosen.limit(1).count():
        edges = edges.union(_by_bucket(loose.join(chosen, "gid", "left_semi"), members.join(chosen, "gid", "left_semi"), banded.join(buckets.select("key"), "key"), least))
    return edges


def _by_block(loose: DataFrame, members: DataFrame, ways: DataFrame, least: float) -> DataFrame:
    """Links between loose members and all of their group."""
    n_loose = ways.select("gid", "n_loose")
    part = F.expr("pmod(xxhash64(node, 2), n_loose)").cast("int")
    lefts = loose.join(n_loose, "gid").select("gid", part.alias("part"), F.explode(F.sequence(F.lit(0), (F.col("n_blocks") - 1).cast("int"))).alias("block"), F.lit(0).alias("side"), "node", "shingles")
    rights = members.join(n_loose, "gid").select("gid", F.explode(F.sequence(F.lit(0), F.col("n_loose") - 1)).alias("part"), "block", F.lit(1).alias("side"), "node", "shingles")
    return _compared(lefts.union(rights), ["gid", "part", "block"], least, _forest)


def _by_bucket(loose: DataFrame, members: DataFrame, banded: DataFrame, least: float) -> DataFrame:
    """Links between loose members and those that share a bucket with them, a large bucket in blocks."""
    marked = loose.select("node").withColumn("loose", F.lit(1))
    inside = cut(banded.join(members.select("node"), "node").join(marked, "node", "left").select("key", "node", F.coalesce("loose", F.lit(0)).alias("loose")).distinct())
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    plan = inside.groupBy("key").agg(parts(F.sum("loose")).alias("n_left"), parts(F.count("*")).alias("n_right")).filter("n_left > 0")
    dealt = inside.join(plan, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n, seed: F.expr(f"pmod(xxhash64(node, {seed}), {n})").cast("int")
    lefts = dealt.filter("loose = 1").select("node", "key", mine("n_left", 2).alias("part"), every("n_right").alias("block"), F.lit(0).alias("side"))
    rights = dealt.select("node", "key", every("n_left").alias("part"), mine("n_right", 3).alias("block"), F.lit(1).alias("side"))
    units = lefts.union(rights).join(members.select("node", "shingles"), "node")
    return _compared(units, ["key", "part", "block"], least, _forest)


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    out = clustered(table(spark, sf_dir, "documents"), 2, 0.8)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
