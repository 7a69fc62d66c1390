"""Stupid-backoff scores, relationally (operator 7).

Tables, and what joins them:

    slices (slice, ids, lens, texts)      whole documents, some SLICE_BYTES of text a row
    grams (bucket, slice, grams, n)       each slice's distinct n-grams of all orders, by hash, with their numbers there
    counts (slice, bucket, counts)        grams, grouped by bucket and n-gram: the numbers in the corpus
    scores (doc_id, n_words, log_score)   slices joined with counts by slice, summed per document

A bucket is a range of hashes, so buckets partition the count tables, and there are as many as the corpus has BUCKET_BYTES;
they are counted in PASSES jobs.
Columns of n-grams and numbers hold sorted arrays, as compressed differences: a row an n-gram would shuffle several times
the text. A slice sends an n-gram once, so one that is in every document is a row a slice.

An n-gram's log score: log(count / count of its prefix) if seen min_count times, else log(0.4) plus the score of its
suffix, down to count / total for words. Words: runs of other than white space, A-Z lower-cased. At a text's start the
shorter n-grams that fit are scored. Null or wordless text: 0 words, null score. Repeated rows of one id are one document of
both texts. Empty table: no rows. A document's n-gram that the corpus lacks counts as seen once. N-grams are told by 64-bit
hashes.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import Stored, map_arrow, mix64, prepare, ragged, table, texts_of
from sorbus.operators.graph import release, shared

BACKOFF = 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLICE_BYTES = 12 << 20
PASSES = 2  # over the slices, each for its share of the buckets: less lies on disk at once
BUCKET_BYTES = 8 << 20


def packed(x: np.ndarray) -> bytes:
    """An array of integers, plane by plane of their bytes, compressed."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()
    return len(x).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(b: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    raw = pa.decompress(b[8:], n * width, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind)


def sliced(docs: DataFrame) -> DataFrame:
    """(slice, ids, lens, texts, bytes, words): whole documents in their order, SLICE_BYTES of text and at least one a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            raw = b"".join(t for _, t in held)
            row = {"slice": uuid.uuid4().int >> 65, "ids": np.array([d for d, _ in held], np.int64).tobytes(), "lens": np.array([len(t) for _, t in held], np.int64).tobytes()}
            row |= {"texts": pa.compress(raw, "zstd", asbytes=True), "bytes": len(raw), "words": sum(len(t.split()) for _, t in held)}
            return pa.RecordBatch.from_pylist([row], pa.schema([("slice", pa.int64()), ("ids", pa.binary()), ("lens", pa.binary()), ("texts", pa.binary()), ("bytes", pa.int64()), ("words", pa.int64())]))

        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text")), strict=True):
                raw = t.encode("utf-8", "surrogatepass").lower()  # of bytes: A-Z alone
                if held and size + len(raw) > SLICE_BYTES:
                    yield out()
                    held, size = [], 0
                held.append((d, raw))
                size += len(raw)
        if held:
            yield out()

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "slice long, ids binary, lens binary, texts binary, bytes long, words long")


def grams(lens: bytes, texts: bytes, size: int, order: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a slice: where its documents' words begin, all n-grams' hashes, by order and place, and of each order its places
    among the words and its range of the hashes."""
    raw, at, words = pa.decompress(texts, size, "zstd", asbytes=True), 0, []
    for n in np.frombuffer(lens, np.int64).tolist():
        words.append(raw[at : at + n].split())
        at += n
    h, begins = ragged(words)
    del words, raw
    inside = np.arange(len(h)) - np.repeat(begins[:-1], np.diff(begins))
    out, places, run, used = [], [], np.zeros(len(h), np.uint64), 0
    for n in range(1, order + 1):
        # The hash of a word and the n - 1 before it; of the order too, so that lengths are kept apart.
        run[1:] = run[:-1] * np.uint64(0x9E3779B97F4A7C15)
        run[:1] = 0
        run += h
        where = np.flatnonzero(inside >= n - 1)
        out.append(mix64(run[where] + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93)))
        places.append((where, np.array([used, used + len(where)])))
        used += len(where)
    return begins, np.concatenate(out), places


def edges(buckets: int) -> np.ndarray:
    """The least hash of each bucket but the first."""
    return np.array([(i << 64) // buckets for i in range(1, buckets)], np.uint64)


def gram_table(slices: DataFrame, order: int, buckets: int, turn: int, asks: bool, tells: bool) -> DataFrame:
    """(bucket, slice, asks, grams, n) of slices, for the buckets of this turn; n is 0 where a slice only asks for counts."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for i, lens, texts, size in zip(*(batch.column(c).to_pylist() for c in ("slice", "lens", "texts", "bytes")), strict=True):
            _, found, _ = grams(lens, texts, size, order)
            found, n = np.unique(found, return_counts=True)
            n = n.astype(np.uint32) if tells else np.zeros(len(n), np.uint32)
            cut = [0, *np.searchsorted(found, edges(buckets)).tolist(), len(found)]
            for b, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
                if hi > lo and b % PASSES == turn:
                    steps = np.diff(found[lo:hi], prepend=np.uint64(0))
                    yield pa.RecordBatch.from_pylist([{"bucket": b, "slice": i, "asks": asks, "grams": packed(steps), "n": packed(n[lo:hi])}], pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("asks", pa.bool_()), ("grams", pa.binary()), ("n", pa.binary())]))

    return map_arrow(slices.select("slice", "lens", "texts", "bytes"), run, "bucket int, slice long, asks boolean, grams binary, n binary")


def count_table(told: DataFrame) -> DataFrame:
    """(slice, bucket, counts): for each row of grams that asks, the corpus's numbers of its n-grams."""

    def counted(rows: list[tuple]) -> Iterator[tuple[int, bytes]]:
        lists = [np.cumsum(unpacked(g, np.uint64), dtype=np.uint64) for _, _, g, _ in rows]
        every = np.concatenate(lists)
        order = np.argsort(every, kind="stable")  # sorted runs are merged
        ranked = every[order]
        new = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
        totals = np.add.reduceat(np.concatenate([unpacked(n, np.uint32) for *_, n in rows])[order].astype(np.int64), new)
        of = np.empty(len(every), np.int64)
        of[order] = np.repeat(totals, np.diff(np.append(new, len(every))))
        at = np.cumsum([0] + [len(x) for x in lists])
        for (i, asks, *_), lo, hi in zip(rows, at, at[1:], strict=False):
            if asks:
                yield i, packed(of[lo:hi])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def out() -> Iterator[pa.RecordBatch]:
            for i, x in counted(held):
                yield pa.RecordBatch.from_pylist([{"slice": i, "bucket": key, "counts": x}], pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary())]))

        for batch in batches:
            for b, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "slice", "asks", "grams", "n")), strict=True):
                if b != key and held:
                    yield from out()
                    held = []
                key = b
                held.append(tuple(row))
        if held:
            yield from out()

    spread = told.repartition("bucket").sortWithinPartitions("bucket")
    return spread.select("bucket", "slice", "asks", "grams", "n").mapInArrow(run, "slice long, bucket int, counts binary")


def doc_scores(lens: bytes, texts: bytes, size: int, counts: list[bytes], order: int, min_count: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and summed log scores of a slice's documents."""
    begins, found, places = grams(lens, texts, size, order)
    words = np.diff(begins)
    if not len(found):
        return words, np.zeros(len(words))
    _, which = np.unique(found, return_inverse=True)
    count = np.maximum(np.concatenate([unpacked(x, np.int64) for x in counts]), 1)[which]
    del found, which
    score = below = None
    for n, (where, (lo, hi)) in enumerate(places, 1):
        c = count[lo:hi]
        if n == 1:
            score = np.log(c / max(total, 1))
        else:
            prefix = below[where - 1]
            score[where] = np.where(c >= min_count, np.log(c / prefix), np.log(BACKOFF) + score[where])
        below = np.zeros(len(score), np.int64)
        below[where] = c
    full = np.flatnonzero(words)
    out = np.zeros(len(words))
    out[full] = np.add.reduceat(score, begins[full])
    return words, out


def lm_scores(docs: DataFrame, order: int = 3, min_count: int = 2, corpus: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, log_score): the summed log scores, rounded to 4 places, of the documents' words.

    Counts come from all of `corpus`, which should hold the documents (by default they are the corpus).
    """
    spark = prepare(docs.sparkSession)
    slices = Stored(sliced(docs))
    others = Stored(sliced(corpus)) if corpus is not None else None
    size, total = (others or slices).df.agg(F.sum("bytes"), F.sum("words")).first()
    parts = max(1, slices.df.count())
    buckets = max(8, -(-(size or 0) // BUCKET_BYTES))
    counts = []
    for turn in range(PASSES):
        told = gram_table(slices.df, order, buckets, turn, True, others is None)
        if others is not None:
            told = told.union(gram_table(others.df, order, buckets, turn, False, True))
        counts.append(Stored(count_table(told)))
        del told
        release(spark)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    both = functools.reduce(DataFrame.union, [c.df for c in counts])
    both = both.select("slice", "bucket", "counts", none("ids", "binary"), none("lens", "binary"), none("texts", "binary"), none("bytes", "long"))
    both = both.union(slices.df.select("slice", F.lit(2**31 - 1), none("counts", "binary"), "ids", "lens", "texts", "bytes"))
    words_in = int(total or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            for c, ids, lens, texts, n in zip(*(batch.column(x).to_pylist() for x in ("counts", "ids", "lens", "texts", "bytes")), strict=True):
                if ids is None:
                    held.append(c)
                    continue
                words, score = doc_scores(lens, texts, n, held, order, min_count, words_in)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(ids, np.int64)), pa.array(words.astype(np.int64)), pa.array(score)], names=["doc_id", "n_words", "s"])
                held = []

    spread = both.repartition(parts, "slice").sortWithinPartitions("slice", "bucket")
    scored = spread.select("counts", "ids", "lens", "texts", "bytes").mapInArrow(run, "doc_id long, n_words long, s double")
    out = shared(scored.groupBy("doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("s").alias("s")))
    for x in (slices, *counts, others):
        if x is not None:
            x.drop()
    release(spark)
    return out.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.round("s", 4) + F.lit(0.0)).alias("log_score"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram scores of all documents under the counts of all documents."""
    return lm_scores(table(spark, sf_dir, "documents"))


LM_SQL = f"""
with w as (select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') w from documents where text is not null and doc_id is not null),
p as (select doc_id, w, unnest(range(1, len(w)+1)) i from w where len(w) > 0),
g as (select doc_id, i, w[i] a, case when i>1 then w[i-1] end b, case when i>2 then w[i-2] end c from p),
u as (select a, count(*) n from g group by 1), t as (select sum(n) n from u),
bi as (select b, a, count(*) n from g where b is not null group by 1,2),
tri as (select c, b, a, count(*) n from g where c is not null group by 1,2,3),
s1 as (select a, ln(u.n/t.n) s from u, t),
s2 as (select bi.b, bi.a, case when bi.n>=2 then ln(bi.n/u.n) else ln(0.4)+s1.s end s from bi join u on bi.b=u.a join s1 on bi.a=s1.a),
s3 as (select tri.c, tri.b, tri.a, case when tri.n>=2 then ln(tri.n/bi.n) else ln(0.4)+s2.s end s from tri join bi on tri.c=bi.b and tri.b=bi.a join s2 on tri.b=s2.b and tri.a=s2.a),
z as (select doc_id, s from g join s1 using (a) where i=1 union all select doc_id, s from g join s2 using (b,a) where i=2 union all select doc_id, s from g join s3 using (c,b,a) where i>2),
y as (select doc_id, count(*) n, sum(s) s from z group by 1)
select distinct d.doc_id, coalesce(y.n,0) n_words, round(y.s,4)+0.0 log_score from documents d left join y using (doc_id) where d.doc_id is not null
"""
