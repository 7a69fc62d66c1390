"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sorbus.operators.graph import Stored, shared_folder  # noqa: F401  Stored is for the operators

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where only the driver's path holds it, and make checkpoint() usable.

    ``spark.checkpoint.dir`` is read from the session; see shared_folder.
    """
    sc = spark.sparkContext
    held = sc.environment.get("PYTHONPATH", "")
    if ROOT not in held.split(":"):
        sc.environment["PYTHONPATH"] = f"{ROOT}:{held}" if held else ROOT
    shared_folder(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, barrier: bool = False) -> DataFrame:
    """mapInArrow whose function sees one batch at a time and keeps nothing between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)

    return df.mapInArrow(run, schema, barrier)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of a column; null is the empty string."""
    return ["" if x is None else x for x in column.to_pylist()]


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id, written as text, leaves 1 by 3: rows that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_rows(df: DataFrame, key: str, value: str, n: int, max_bytes: int) -> list[Row]:
    """At most n rows of df, of which the column `value` has at most max_bytes in all: those least by a hash of their key.

    Which rows they are is known from hashes and lengths, so the driver gets no other value; a row that does not fit in
    what is left of max_bytes is passed over. Rows that share a key are taken as far as both bounds allow.
    """
    rows = df.count()
    if not rows or n <= 0:
        return []
    h = F.xxhash64(F.col(key), F.lit(20))
    share = min(1.0, n / rows + 6 * (n**0.5 + 1) / rows)  # beyond the mean by six deviations
    below = F.lit(True) if share == 1 else h < F.lit(int((share - 0.5) * 2**64))
    size = F.octet_length(value) if dict(df.dtypes)[value] == "string" else F.size(value) * 8
    named = df.where(below).select(F.col(key).alias("key"), F.coalesce(size, F.lit(0)).alias("size"), h.alias("h"))
    left, count, keys = max_bytes, 0, set()
    for r in named.orderBy("h", "key", "size").limit(2 * n).collect():
        if count < n and 0 <= r.size <= left:
            left, count = left - r.size, count + 1
            keys.add(r.key)
    if not keys:
        return []
    picked = df.sparkSession.createDataFrame([(k,) for k in keys], f"`{key}` {dict(df.dtypes)[key]}")
    out, left = [], max_bytes
    for r in df.where(below).join(F.broadcast(picked), key, "left_semi").where(size <= max_bytes).orderBy(h, key, size).limit(n).toLocalIterator():
        held = len(r[value].encode("utf-8", "surrogatepass")) if isinstance(r[value], str) else 8 * len(r[value])
        if held <= left:
            left -= held
            out.append(r)
    return out


M1, M2, M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3, a bijection."""
    x = x ^ (x >> M3)
    x = x * M1
    x ^= x >> M3
    x *= M2
    x ^= x >> M3
    return x


class WordHashes(dict):
    """word, as text or as its bytes in lower case -> 64-bit hash, kept between batches up to a bound."""

    LIMIT = 80_000

    def __missing__(self, word: str | bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) >= self.LIMIT:
                self.clear()
            self[word] = h
        return h


WORD_HASHES = WordHashes()


def ragged(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each list's begin (one more entry than lists)."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    at = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(at[-1], np.uint64)
    get = WORD_HASHES.__getitem__
    for k, w in enumerate(words):
        out[at[k] : at[k + 1]] = np.fromiter(map(get, w), np.uint64, len(w))
    return out, at


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the k-word shingles of each list, and where each list's begin.

    A list of fewer than k words, but not none, gives one shingle: the whole list.
    """
    n = np.diff(at)
    factor = np.uint64(0x9E3779B97F4A7C15)
    if len(h) >= k:
        x = np.zeros(len(h) - k + 1, np.uint64)
        for j in range(k):
            x *= factor
            x += h[j : j + len(x)]
        x = mix64(x)
    else:
        x = np.empty(0, np.uint64)
    made = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    to = np.concatenate([[0], np.cumsum(made)])
    keep = np.repeat(at[:-1] - to[:-1], made) + np.arange(to[-1])
    short = np.flatnonzero((n > 0) & (n < k))
    if not len(short):
        return x[keep], to
    out = np.empty(to[-1], np.uint64)
    long = np.repeat(n >= k, made)
    out[long] = x[keep[long]]
    for d in short:
        y = np.uint64(n[d])
        with np.errstate(over="ignore"):
            for w in h[at[d] : at[d + 1]]:
                y = y * factor + w
        out[to[d]] = mix64(np.array([y ^ np.uint64(0x5851F42D4C957F2D)]))[0]
    return out, to
