"""Toxicity by weak supervision.

Voters look at a text: one for each entry of a small lexicon of insults, one for each
word or word beginning that labelled rows show to be telling, and patterns (several
lexicon hits, hits together with an address, none at all). Labels choose the voters and nothing
else: the generative label model sees votes only. Fitted by expectation maximisation, it
estimates the share of toxic texts, how often each voter fires on toxic and on other texts, and from
what is left over which voters are correlated; correlated ones share one vote's weight. Its
posteriors, made of the votes alone, are the labels on which a linear classifier over words and word
beginnings is trained, with an L1 penalty.

Only the classifier scores texts. It is fitted on at most SAMPLE labelled rows, the
documented bound, and its weights are a few thousand numbers, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.llm.common import raw, small_batches, steps, table
from prismtab.llm.words import spans, word_hashes

#: Labelled rows that the classifier is fitted on at most: those with the least hash of their id, equal texts once.
SAMPLE = 4000
SPACE_BITS = 18
#: Lengths in bytes of word beginnings that count as features beside whole words.
STEMS = (4, 5, 6, 7)
#: Telling features that become voters at most, and in how many toxic rows one must be.
MINED, LEAST = 160, 3
THRESHOLD = 0.3
#: Bytes of text whose features are held at a time.
STEP = 1 << 20
#: Slots that the classifier looks at.
SCREENED = 3000
#: The seed lexicon: common insults.
LEXICON = (
    "idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "imbecile", "jerk", "creep", "garbage", "filth", "vermin", "cretin", "fool", "coward",
    "idiota", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "payaso", "cretino", "tonto", "inútil",
    "connard", "crétin", "imbécile", "débile", "ordure", "pourriture", "minable", "dégoûtant", "abruti", "raclure",
    "dummkopf", "trottel", "abschaum", "versager", "widerlich", "vollidiot", "arschloch", "erbärmlich", "dreckskerl", "schwachkopf",
)
_YOU = ("you", "your", "tu", "vous", "du", "ihr", "usted")

_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = [c if chr(c).isalnum() else 0x20 for c in range(128)]
_MAP[65:91] += 32


def features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash (uint64) of each word and word beginning, repeated as often as they occur. Letters are lower-cased by the caller."""
    body, offsets = raw(col)
    body = _MAP[body]
    starts, ends, row = spans(body, offsets)
    rows, hashes = [row], [word_hashes(body, starts, ends)]
    for k in STEMS:
        some = ends - starts > k
        rows.append(row[some])
        hashes.append(word_hashes(body, starts[some], starts[some] + k) ^ np.uint64(0x5851F42D4C957F2D * k & 0xFFFFFFFFFFFFFFFF))
    return np.concatenate(rows), np.concatenate(hashes)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SPACE_BITS)).astype(np.int64)


def _word_slots(words: tuple[str, ...]) -> list[int]:
    rows, hashes = features(pa.array([w.lower() for w in words]))
    first = np.searchsorted(rows[: len(words)], np.arange(len(words)))
    return _slots(hashes)[first].tolist()


@dataclass
class LabelModel:
    """How often each voter fires on toxic texts and on others, each voter's share of a vote, and the share of toxic texts."""

    toxic: np.ndarray
    other: np.ndarray
    share: np.ndarray
    prior: float

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The chance that each row is toxic."""
        log = lambda a, b: np.log(a) - np.log(b)
        fired, silent = log(self.toxic, self.other) * self.share, log(1 - self.toxic, 1 - self.other) * self.share
        z = log(self.prior, 1 - self.prior) + votes @ (fired - silent) + silent.sum()
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def label_model(votes: np.ndarray, rounds: int = 40) -> LabelModel:
    """Fitted by expectation maximisation, from votes alone. votes: rows x voters, fired or not, the last one speaking against toxic.

    It starts from the share of votes: a text on which two voters or more fire is taken for toxic at first.
    """
    n, m = votes.shape
    v = votes.astype(np.float64)
    p = np.clip(v[:, :-1].sum(1) / 2, 0.02, 0.95)
    model = None
    for _ in range(rounds):
        t, o = p.sum(), (1 - p).sum()
        toxic = np.clip((p @ v + 0.5) / (t + 1), 1e-3, 1 - 1e-3)
        other = np.clip(((1 - p) @ v + 0.5) / (o + 1), 1e-3, 1 - 1e-3)
        # Left over once the class is known: voters that still fire together are one opinion heard twice.
        centered = v - p[:, None] * toxic - (1 - p)[:, None] * other
        norm = np.sqrt((centered**2).mean(0)) + 1e-9
        correlation = np.abs((centered.T @ centered) / n / np.outer(norm, norm))
        together = np.where(correlation > 0.3, correlation, 0)
        np.fill_diagonal(together, 1)
        model = LabelModel(toxic, other, 1 / together.sum(1), float(np.clip(t / n, 0.005, 0.6)))
        p = model.posterior(votes)
    return model


@dataclass
class Classifier:
    """The slots with a weight, their weights, and the bias."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << SPACE_BITS, np.float32)
        out[self.slots] = self.weights
        return out


def linear(row: np.ndarray, slot: np.ndarray, target: np.ndarray, l1: float = 4e-4, rounds: int = 400) -> Classifier:
    """Logistic regression on the presence of the SCREENED most telling slots, with an L1 penalty, by accelerated proximal gradient."""
    n, share = len(target), float(np.clip(target.mean() if len(target) else 0.1, 1e-3, 1 - 1e-3))
    bias = float(np.log(share / (1 - share)))
    fired = np.bincount(slot, minlength=1 << SPACE_BITS)
    on_toxic = np.bincount(slot, target[row], 1 << SPACE_BITS)
    z = np.abs(on_toxic - share * fired) / np.sqrt(share * (1 - share) * fired + 1)
    kept = np.sort(np.argsort(-z, kind="stable")[:SCREENED])
    kept = kept[z[kept] > 2]
    if not len(kept):
        return Classifier(np.zeros(0, np.int64), np.zeros(0, np.float32), bias)
    at = np.full(1 << SPACE_BITS, -1, np.int64)
    at[kept] = np.arange(len(kept))
    used = at[slot] >= 0
    x = np.zeros((n, len(kept) + 1), np.float32)
    x[row[used], at[slot[used]]] = 1
    x[:, -1] = 1  # the bias, not penalised
    u = np.ones(x.shape[1], np.float32)
    for _ in range(12):
        u = x.T @ (x @ u)
        norm = float(np.linalg.norm(u))
        u /= norm
    step = np.float32(4 * n / norm)
    w, t = np.zeros(x.shape[1], np.float32), 1.0
    w[-1] = bias
    y, least = w.copy(), np.full(x.shape[1], step * l1, np.float32)
    least[-1] = 0
    for _ in range(rounds):
        g = x.T @ (_sigmoid(x @ y) - target).astype(np.float32) / n
        new = y - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - least, 0)
        if float((y - new) @ (new - w)) > 0:
            t = 1.0  # the momentum points back
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, w, t = new + np.float32((t - 1) / nt) * (new - w), new, nt
    some = np.flatnonzero(np.abs(w[:-1]) > 1e-6)
    return Classifier(kept[some], w[some], float(w[-1]))


def voters(row: np.ndarray, slot: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Votes (rows x voters), the last one against toxic, and the slots of the mined voters."""
    n = len(toxic)
    fired = np.zeros((1 << SPACE_BITS,), np.int64)
    fired_toxic = np.zeros_like(fired)
    np.add.at(fired, slot, 1)
    np.add.at(fired_toxic, slot, toxic[row].astype(np.int64))
    share = toxic.mean() if n else 0
    score = np.where(fired_toxic >= LEAST, (fired_toxic - share * fired) / np.sqrt(fired + 1.0), 0)
    precise = np.where(fired > 0, fired_toxic / np.maximum(fired, 1), 0) > 0.6 + 0.4 * share
    ranked = np.argsort(-np.where(precise, score, 0), kind="stable")[: 4 * MINED]
    order = np.argsort(slot, kind="stable")
    by_slot, by_row = slot[order], row[order]

    def where(s: int) -> np.ndarray:
        a, b = np.searchsorted(by_slot, (s, s + 1))
        return by_row[a:b]

    # Of mined voters that fire on the same rows, one is enough.
    chosen: dict[bytes, int] = {}
    for s in ranked[precise[ranked] & (score[ranked] > 0)].tolist():
        chosen.setdefault(np.sort(where(s)).tobytes(), s)
    mined = list(chosen.values())[:MINED]
    columns = [*mined, *[s for s in dict.fromkeys(_word_slots(LEXICON)) if s not in mined]]
    votes = np.zeros((n, len(columns) + 4), bool)
    for j, s in enumerate(columns):
        votes[where(s), j] = True
    hits = votes.sum(1)
    you = np.isin(slot, _word_slots(_YOU))
    address = np.zeros(n, bool)
    address[row[you]] = True
    votes[:, -4], votes[:, -3], votes[:, -2], votes[:, -1] = hits >= 2, hits >= 4, address & (hits >= 1), hits == 0
    return votes, mined


def fit_arrays(toxic: np.ndarray, each: list[np.ndarray]) -> tuple[Classifier, LabelModel | None]:
    """The classifier, and the label model unless all rows have one label. each: the different slots of each row."""
    fired, on_toxic = np.zeros(1 << SPACE_BITS, np.int32), np.zeros(1 << SPACE_BITS, np.int32)
    for t, slots in zip(toxic, each, strict=True):
        fired[slots] += 1
        if t:
            on_toxic[slots] += 1
    # Slots that tell nothing are let go before any table of rows and slots is made.
    share = float(toxic.mean()) if len(toxic) else 0.0
    telling = (fired >= LEAST - 1) & (np.abs(on_toxic - share * fired) > np.sqrt(share * (1 - share) * fired + 1e-9))
    kept = [x[telling[x]] for x in each]
    slot = np.concatenate(kept).astype(np.int64) if kept else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(kept)), [len(x) for x in kept]) if kept else np.zeros(0, np.int64)
    if not 0 < toxic.sum() < len(toxic):
        return linear(row, slot, toxic), None
    votes, _ = voters(row, slot, toxic)
    model = label_model(votes)
    return linear(row, slot, model.posterior(votes)), model


def fit(sample: DataFrame) -> Classifier:
    """sample: text, toxic (0 or 1), SAMPLE rows at most; null toxic rows are left out. One task fits the bounded sample, and only the weights come to the driver."""

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                row, hashes = features(part.column(1))
                keys = np.unique(row << SPACE_BITS | _slots(hashes))
                edges = np.searchsorted(keys >> SPACE_BITS, np.arange(len(part) + 1)).tolist()
                slots = (keys & ((1 << SPACE_BITS) - 1)).astype(np.int32)
                yield pa.record_batch([part.column(0), pa.array([slots[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())], ["toxic", "slots"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((t, s) for batch in batches for t, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        model, _ = fit_arrays(np.array([t for t, _ in rows], np.float64), [np.frombuffer(s, np.int32) for _, s in rows])
        yield pa.record_batch([pa.array([model.slots.tolist()], pa.list_(pa.int64())), pa.array([model.weights.tolist()], pa.list_(pa.float32())), pa.array([model.bias], pa.float64())], ["slots", "weights", "bias"])

    texts = sample.filter("toxic is not null").select(F.col("toxic").cast("int").alias("toxic"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    r = texts.mapInArrow(featured, "toxic int, slots binary").repartition(1).mapInArrow(fitted, "slots array<long>, weights array<float>, bias double").first()
    return Classifier(np.array(r["slots"], np.int64), np.array(r["weights"], np.float32), r["bias"])


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """text, toxic of at most `most` labelled rows whose crc32(doc_id as text) mod 4 is not 2, equal texts once.

    The ids are chosen first, by hash, among twice as many, so only they (2 * most numbers) are broadcast and only their texts
    are shuffled. An id with several labels is toxic if one of them says so; of equal texts the row with the least id
    counts, so the rows are the same whatever the order of tasks.
    """
    chosen = labels.filter("toxic is not null and doc_id is not null").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    chosen = chosen.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    once = found.groupBy("text").agg(F.min(F.struct("doc_id", "toxic")).alias("r")).select("text", "r.doc_id", "r.toxic")
    return once.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most).select("text", "toxic")


def score(docs: DataFrame, model: Classifier, keep: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """doc_id, score (0 to 1, rounded to 9 places) and predicted of every row; with keep, all columns of docs before them.

    names are the two columns' names, for docs that have columns of these names. Null text counts as empty, whose score
    is the bias's. Equal texts have equal scores. doc_id is passed on as it is; an empty table gives none.
    """
    weights, bias = model.table(), model.bias
    carried = docs if keep else docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    n = len(carried.columns)
    columns = [f"c{i}" for i in range(n + 1)]  # a column of any name may come along

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, columns[-1], STEP):
                row, hashes = features(part.column(n))
                slot = _slots(hashes)
                used = weights[slot] != 0
                keys = np.unique(row[used] << SPACE_BITS | slot[used])
                total = np.bincount(keys >> SPACE_BITS, weights[keys & ((1 << SPACE_BITS) - 1)].astype(np.float64), len(part))
                s = np.round(_sigmoid(bias + total), 9)
                yield pa.record_batch([*part.columns[:n], pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=[*columns[:n], "s", "p"])

    low = F.lower(F.coalesce("text", F.lit("")))
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns], low) if keep else docs.select(F.col("doc_id").cast("long"), low)
    fields = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, carried.schema.fields, strict=False))
    return source.toDF(*columns).mapInArrow(work, f"{fields}, s double, p int").toDF(*carried.columns, *names)


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(training_rows(docs, table(spark, sf_dir, "labels"))))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", "predicted")
