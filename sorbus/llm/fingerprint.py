"""Threshold-scaled sketches (operator 3): every shingle hash below a fixed fraction of all hashes is retained.

A hash has 40 bits; SCALE keeps those below 2^40 / SCALE. A text that has fewer than LEAST of them keeps its LEAST smallest
instead, or all it has: its bound is higher, never lower. Two sketches are compared, and sketches of parts merged, below the
lower of their bounds, so a share of the retained hashes estimates containment however unequal two texts are. From n common
hashes an estimate errs by about 1 / sqrt(4 n). Null or wordless text: an empty sketch. If nothing lies below the common
bound, containment is 0 and likeness is 1 for equal texts, else 0. A text with fewer words than a shingle has one shingle.
Repeated ids follow each other in the order of their texts; rows without an id are left out; other columns, whatever their
names, are not read. A text is one value in one task, however long, and its sketch grows with its distinct shingles.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import prepare, ragged, shingles, table
from sorbus.llm.jaccard import words_of


BITS = 40  # five bytes a hash: two sketches of 10,000 hashes share one by chance in one pair of 10,000
SCALE = 32
LEAST = 32


class Sketch(NamedTuple):
    hashes: np.ndarray  # sorted, distinct, all of the text's that are below bound
    bound: int


def sketch(text: str, k: int = 5, scale: int = SCALE, least: int = LEAST) -> Sketch:
    h = np.unique(shingles(*ragged([words_of(text)]), k)[0] >> np.uint64(64 - BITS))
    bound = -(-(1 << BITS) // scale)
    n = int(np.searchsorted(h, bound))
    if n < least:
        n = min(least, len(h))
        bound = int(h[n]) if n < len(h) else 1 << BITS
    return Sketch(h[:n], bound)


def below(a: Sketch, bound: int) -> np.ndarray:
    return a.hashes[: np.searchsorted(a.hashes, bound)]


def merge(a: Sketch, b: Sketch) -> Sketch:
    """The sketch, below the lower bound, of the two texts' shingles together."""
    bound = min(a.bound, b.bound)
    return Sketch(np.union1d(below(a, bound), below(b, bound)), bound)


def compared(a: Sketch, b: Sketch) -> tuple[int, int, int]:
    """Numbers of hashes of a, of b and of both, below their common bound."""
    bound = min(a.bound, b.bound)
    x, y = below(a, bound), below(b, bound)
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def containment(a: Sketch, b: Sketch) -> float:
    """Estimated share of a's shingles that b holds."""
    n, _, both = compared(a, b)
    return both / n if n else 0.0


def likeness(a: Sketch, b: Sketch, same: bool) -> float:
    """Estimated Jaccard likeness; `same` (equal texts) decides where there is nothing to compare."""
    n, m, both = compared(a, b)
    return both / (n + m - both) if n + m else float(same)


def to_text(s: Sketch) -> str:
    """The bound (2^40 as 0) and the hashes, five bytes each, in base 64."""
    every = np.concatenate([np.array([s.bound % (1 << BITS)], np.uint64), s.hashes]).astype(">u8")
    return base64.b64encode(every.view(np.uint8).reshape(-1, 8)[:, 3:].tobytes()).decode()


def from_text(s: str) -> Sketch:
    raw = np.frombuffer(base64.b64decode(s), np.uint8).reshape(-1, BITS // 8)
    every = np.pad(raw, ((0, 0), (3, 0))).copy().view(">u8")[:, 0].astype(np.uint64)
    return Sketch(every[1:], int(every[0]) or 1 << BITS)


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """(bucket, extra, doc_id, text) by ranges of doc_id; each bucket ends with a copy of the next one's first row.

    The ids alone are dealt to ranges first; the driver learns the least id of each, one number a range.
    """

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = min((pc.min(b.column(0)).as_py() for b in batches if b.num_rows), default=None)
        if found is not None:
            yield pa.RecordBatch.from_arrays([pa.array([found], pa.int64())], names=["least"])

    ranges = docs.select("doc_id").repartitionByRange(parts, "doc_id").mapInArrow(least, "least long")
    firsts = sorted({r.least for r in ranges.collect()})
    if not firsts:
        return docs.select(F.lit(0).alias("bucket"), "doc_id", "text", F.lit(0).alias("extra"))
    bounds, last = np.array(firsts[1:], np.int64), len(firsts) - 1

    @F.pandas_udf("int")
    def range_of(x: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right").astype(np.int32))

    text = F.coalesce("text", F.lit("")).alias("text")
    dealt = docs.select(range_of("doc_id").alias("bucket"), "doc_id", text, F.lit(0).alias("extra"))
    first = docs.where(F.col("doc_id").isin(firsts)).select("doc_id", text).groupBy("doc_id").agg(F.min("text").alias("text"))
    before = F.when(F.col("doc_id") == firsts[0], last).otherwise(range_of("doc_id") - 1)
    return dealt.unionByName(first.select(before.alias("bucket"), "doc_id", "text", F.lit(1).alias("extra")))


def fingerprints(docs: DataFrame, k: int = 5, scale: int = SCALE, least: int = LEAST) -> DataFrame:
    """Per document its sketch and that of its edited text, how alike they and the next document's are, and the shares of its
    shingles that these hold (containment)."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    parts = max(8, docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions())
    rows = with_next(docs, parts).repartition(parts, "bucket").sortWithinPartitions("bucket", "extra", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            for b, x, d, t in zip(*(batch.column(c).to_pylist() for c in ("bucket", "extra", "doc_id", "text")), strict=True):
                s = sketch(t, k, scale, least)
                if held is not None and held[0] == b:
                    _, d0, t0, s0 = held
                    e = edited(t0, t)
                    se = sketch(e, k, scale, least)
                    sha = hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((d0, len(t0), sha, to_text(s0), to_text(se), likeness(s0, se, t0 == e), likeness(s0, s, t0 == t), containment(s0, se), containment(s0, s)))
                held = None if x else (b, d, t, s)
            for lo in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[lo : lo + 1000], strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "in_edited", "in_next"])

    return rows.select("bucket", "extra", "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double")


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(table(spark, sf_dir, "documents"))
