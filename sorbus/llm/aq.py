"""Nearest neighbours by additive quantisation (operator 5).

A vector is coded as a sum of one full-dimensional codeword per book, found by beam search over residual codebooks; its
code and squared norm are stored. Queries are scored from look-up tables of their inner products with all codewords. Each
query has a least score: that which the best sixteenth of the sample, 400 rows of the table at least, reach. All rows that
score as much are ranked again on the original vectors, in double precision. So what is ranked again does not depend on how
the rows lie in files, partitions or batches, and equal vectors, which have equal codes, are all ranked again, or none is.

The queries are answered a block at a time: the driver and every executor hold one block, and each is a pass over the codes.

Vectors that are null, zero, of another length than the most common one, or hold null or non-finite components take no
part. Ties go to the smaller vec_id. Repeated ids: each row is a candidate for other ids; the query is the row of the least
vector, component by component. Other columns, whatever their names, are not read. An empty table gives no rows. The
codebooks and least scores are fitted on at most `sample` rows (64 MB); every row is coded and searched.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorbus.llm.common import map_arrow, prepare, sample_rows, table
from sorbus.operators.graph import shared, shared_folder

BOOKS, WORDS, BEAM = 8, 256, 8
SHARE = 16
SAMPLE_BYTES = 64 << 20
SCHEMA = "query_id long, vec_id long, score double"


def vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)


def usable(df: DataFrame, col: str = "embedding") -> DataFrame:
    good = F.expr(f"{col} is not null and size({col}) > 0 and forall({col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({col}, x -> x != 0)")
    return df.where("vec_id is not null").where(F.coalesce(good, F.lit(False))).select("vec_id", F.col(col).cast("array<double>").alias("v"))


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = 12) -> np.ndarray:
    """Codebooks by k-means on residuals, then all together by least squares on beam-searched codes."""
    rng, res, out = np.random.default_rng(5), x.copy(), []
    for _ in range(books):
        c = res[rng.choice(len(res), words, replace=len(res) < words)].copy()
        for _ in range(rounds):
            near = ((c**2).sum(1)[None] - 2 * res @ c.T).argmin(1)
            n = np.bincount(near, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, near, res)
            c[n > 0] = total[n > 0] / n[n > 0][:, None]
        res -= c[((c**2).sum(1)[None] - 2 * res @ c.T).argmin(1)]
        out.append(c)
    books_ = np.array(out)
    for _ in range(2):
        code = encode(x, books_)
        both, total = np.zeros((books, words, books, words)), np.zeros((books, words, x.shape[1]))
        for m in range(books):
            np.add.at(total[m], code[:, m], x)
            for o in range(books):
                both[m, :, o] = np.bincount(code[:, m] * words + code[:, o], minlength=words**2).reshape(words, words)
        n = books * words
        books_ = np.linalg.solve(both.reshape(n, n) + 1e-2 * np.eye(n), (total + 1e-2 * books_).reshape(n, -1)).reshape(books_.shape)
    return books_


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows, books): the `beam` best partial sums are kept from book to book."""
    out = []
    words, norms = books.shape[1], (books**2).sum(2)
    for lo in range(0, len(x), 512):
        part = x[lo : lo + 512]
        n = len(part)
        res, cost, code = part[:, None, :], (part**2).sum(1)[:, None], np.zeros((n, 1, 0), np.int64)
        for m, c in enumerate(books):
            new = (cost[:, :, None] + norms[m][None, None] - 2 * res @ c.T).reshape(n, -1)
            keep = np.argpartition(new, min(beam, new.shape[1]) - 1, 1)[:, :beam]
            row = np.arange(n)[:, None]
            old, word = keep // words, keep % words
            cost, res = new[row, keep], res[row, old] - c[word]
            code = np.concatenate([code[row, old], word[:, :, None]], 2)
        out.append(code[np.arange(n), cost.argmin(1)])
    return np.concatenate(out) if out else np.zeros((0, len(books)), np.int64)


def index(df: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, v, code, norm) for every row."""
    held = prepare(df.sparkSession).sparkContext.broadcast(books)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        b = held.value
        code = encode(vectors(batch.column("v"), b.shape[2]), b)
        made = sum(b[m][code[:, m]] for m in range(len(b)))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(list(code.astype(np.uint8).tobytes()[i * len(b) : (i + 1) * len(b)] for i in range(len(code))), pa.binary()), pa.array((made**2).sum(1))], names=["vec_id", "v", "code", "norm"])

    return map_arrow(df, run, "vec_id long, v array<double>, code binary, norm double")


def scored(q: np.ndarray, code: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Inner products (queries, rows) of queries with coded rows, by look-up tables."""
    lut = np.einsum("qd,mwd->mqw", q, books).astype(np.float32)
    near = np.zeros((len(q), len(code)), np.float32)
    for m in range(len(lut)):
        near += lut[m][:, code[:, m]]
    return near


def least_scores(q: np.ndarray, code: np.ndarray, books: np.ndarray, rows: int, rerank: int) -> np.ndarray:
    """Per query the score that a sixteenth of the coded sample, or as much as stands for `rerank` of all rows, reaches."""
    top = min(len(code), -(-len(code) * max(1, min(rows, max(rerank, -(-rows // SHARE)))) // max(1, rows)))
    if top == len(code):
        return np.full(len(q), -np.inf)
    out = np.empty(len(q))
    for lo in range(0, len(q), 64):
        part = q[lo : lo + 64]
        rounding = 1e-5 * np.abs(np.einsum("qd,mwd->mqw", part, books)).max(2).sum(0)  # ties stay ties in any order of sums
        out[lo : lo + 64] = np.partition(scored(part, code, books), len(code) - top, 1)[:, len(code) - top] - rounding
    return out


def search(df: DataFrame, every: int = 20, k: int = 20, rerank: int = 400, sample: int = 20_000, block: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` its k rows of largest inner product.

    About a sixteenth of all rows, `rerank` rows at least, is ranked again. A block of queries is at most `block`.
    """
    spark = prepare(df.sparkSession)
    rows = usable(df)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = common.d
    rows = rows.where(F.size("v") == dim)
    learned = np.array([r.v for r in sample_rows(rows, "vec_id", "v", sample, SAMPLE_BYTES)], float)
    coded = index(rows, books := fit(learned)).checkpoint()
    n_rows, seen = coded.count(), encode(learned, books)
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-asked.count() // (block // 2)))
    asked = asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks))).checkpoint()
    folder = f"{shared_folder(spark)}/found-{uuid.uuid4().hex}"
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for i in range(n_blocks):
        got = asked.where(F.col("b") == i).orderBy("vec_id").select("vec_id", "v").toArrow()
        if not len(got):
            continue
        q = np.array(got["v"].to_pylist(), float)
        held = spark.sparkContext.broadcast((np.array(got["vec_id"].to_pylist()), q, least_scores(q, seen, books, n_rows, rerank)))

        def run(batch: pa.RecordBatch, held=held) -> Iterator[pa.RecordBatch]:
            qid, q, least = held.value
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            ids, x = batch.column("vec_id").to_numpy(zero_copy_only=False), vectors(batch.column("v"), dim)
            for lo in range(0, len(q), 128):
                near = scored(q[lo : lo + 128], code, books)
                for j in range(len(near)):
                    cand = np.flatnonzero(near[j] >= least[lo + j])
                    cand = cand[ids[cand] != qid[lo + j]]
                    exact = np.array([np.dot(x[c], q[lo + j]) for c in cand]) if len(cand) <= k else x[cand] @ q[lo + j]
                    best = cand[np.lexsort((ids[cand], -exact))[:k]]
                    if len(best):
                        yield pa.RecordBatch.from_arrays([pa.repeat(int(qid[lo + j]), len(best)), pa.array(ids[best]), pa.array(np.array([float((x[c] * q[lo + j]).sum()) for c in best]))], names=["query_id", "vec_id", "score"])

        part = map_arrow(coded.select("vec_id", "v", "code"), run, SCHEMA)
        ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score").write.mode("append").parquet(folder)
        held.destroy()
    schema = "query_id long, rank int, vec_id long, score double"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return spark.createDataFrame([], schema)
    out = shared(spark.read.schema(schema).parquet(folder))
    files.delete(path, True)
    return out


def op5_aq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th embedding."""
    return search(table(spark, sf_dir, "embeddings"))
