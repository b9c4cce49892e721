"""Media columns: payloads stored as FLAC, read back block by block, and features of what was read."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismtab.llm import flac
from prismtab.llm.common import small_batches, steps, table

#: Payloads are padded with blanks to a positive multiple of this.
FRAME = 192
#: Bytes that the codec works on at a time; a larger payload is worked on alone.
STEP = 1 << 20


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, payload_bytes, media: each text's UTF-8 bytes, padded, as a FLAC stream. Null text counts as empty."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text", STEP):
                data = [x or b"" for x in pc.cast(part.column(1), pa.binary()).to_pylist()]
                padded = [x + b" " * (-len(x) % FRAME or (0 if x else FRAME)) for x in data]
                yield pa.record_batch([part.column(0), pa.array([len(x) for x in data], pa.int64()), pa.array([len(x) for x in padded], pa.int64()), pa.array(flac.encode(padded), pa.binary())], ["doc_id", "n_bytes", "payload_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, media binary")


def blocks(media: DataFrame) -> DataFrame:
    """Seekable PCM: a row for each block of each stream in `media`, with doc_id, sample_offset, n_samples and pcm.

    A stream whose frame checksums or MD5 are wrong raises ValueError; null media gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media", STEP):
                ids, data = part.column(0).to_pylist(), part.column(1).to_pylist()
                rows = [(ids[i], b.offset, len(b.pcm), b.pcm) for i, d in zip([i for i, x in enumerate(data) if x is not None], flac.decode([x for x in data if x is not None]), strict=True) for b in d]
                yield pa.record_batch([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "sample_offset", "n_samples", "pcm"])

    return media.select("doc_id", "media").mapInArrow(work, "doc_id long, sample_offset long, n_samples long, pcm binary")


def feature(pcm: bytes, n_blocks: int) -> str:
    """Samples, blocks, mean and energy of 8-bit samples around 128, zero crossings and peak, all in whole numbers."""
    x = np.frombuffer(pcm, np.uint8).astype(np.int32) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return f"n={len(x)};blocks={n_blocks};sum={int(x.sum(dtype=np.int64))};energy={int(np.dot(x, x)) if len(x) < 100_000 else int((x.astype(np.int64) ** 2).sum())};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


def digests(stored: DataFrame) -> DataFrame:
    """Decodes each stored stream and returns digests and features of the payload that was read back."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "media", STEP):
                media = part.column(3).to_pylist()
                rows = []
                for m, d in zip(media, flac.decode(media), strict=True):
                    pcm = b"".join(b.pcm for b in d)
                    rows.append((hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(pcm, len(d))))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([*part.columns[:3], *[pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return digests(store(table(spark, sf_dir, "documents")))
