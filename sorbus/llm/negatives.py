"""Hard negatives by bit-sliced integer products (operator 13).

Components become integers. A row's integers are cut into bit-planes, the sign's first; the product of an anchor with the
planes so far bounds its score: what the open planes can still add is at most the sum of the anchor's positive components,
and at least that of its negative ones, times the largest number these planes can hold. Plane by plane the intervals get
narrower, and a pair goes as soon as its interval misses every band of scores that is asked for, or lies below what is known
to be among the first there. What is left after the last plane has its exact score.

The first pass asks, among the rows of an anchor's label, for the first `positives`. Each of them sets a band, and the
second pass asks, among the rows of other labels, for the first `negatives` in each band.

Anchors are answered a block at a time, which the driver and every task hold; each block is two passes over all rows. A task
gives the first rows that it has seen for each anchor and band; a window takes the first of all tasks'.

Rows with a null id or label, a null vector, or a null or non-finite component take no part, nor do rows whose integers are
so large that a score could leave 64 bits: the square of the largest, times the length, must be below LARGEST. Only vectors
of the anchor's length score. Every row is a candidate, repeated ones too, but none of the anchor's own id; of rows that
share an anchor's id, the least by label and vector is the anchor. Other columns are not read, whatever their names. An
empty table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sorbus.llm.common import prepare, table
from sorbus.operators.graph import Stored, shared, shared_folder

LARGEST = 2.0**55
ROWS, ANCHORS = 2048, 512  # of a tile whose pairs are compared at once
PLANES = 2  # that are added before pairs are dropped again; the first time, a few more
DENSE = 8  # a tile of which at least one pair in so many is left is multiplied whole
PAIRS = 1 << 16  # that are gathered at once
OPEN = np.iinfo(np.int64).min
FOUND = "anchor int, band int, vec_id long, score long"
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def integers(df: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): usable rows of df, with integer components."""
    good = F.expr("embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    rows = df.where("vec_id is not null and label is not null").where(F.coalesce(good, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double")).alias("r"))
    most = F.aggregate("r", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))
    return rows.where(most * most * F.size("r") < LARGEST).select("vec_id", "label", F.col("r").cast("array<int>").alias("v"))


def exact_type(bits: int, anchors: np.ndarray) -> type:
    """The fastest type in which every sum of products is exact."""
    most = float(np.abs(anchors).sum(1).max(initial=0)) * 2.0**bits
    return np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64


class Planes:
    """The planes of some rows: planes `top` to `low` of each component, as one number, are (v >> low) below 2^(top - low)."""

    def __init__(self, v: np.ndarray):
        self.v = v
        self.bits = int(max(v.max(initial=0), -v.min(initial=0) - 1)).bit_length()  # besides the sign

    def first(self, low: int) -> np.ndarray:
        return self.v >> low

    def next(self, top: int, low: int) -> np.ndarray:
        return (self.v >> low) & ((1 << (top - low)) - 1)


class Found:
    """The first k candidates of each anchor and band that a task has seen."""

    def __init__(self, n: int, bands: int, k: int):
        self.n, self.bands, self.k = n, bands, k
        self.at = np.empty((4, 0), np.int64)  # anchor, band, id, score

    def least(self) -> np.ndarray:
        """Per anchor and band the k-th score, or none yet."""
        out = np.full((self.n, self.bands), OPEN)
        a, b, _, s = self.at
        if self.at.shape[1]:
            group = a * self.bands + b
            first = np.flatnonzero(np.append(True, np.diff(group) > 0))
            size = np.diff(np.append(first, len(group)))
            full = first[size >= self.k] + self.k - 1
            out[a[full], b[full]] = s[full]
        return out

    def add(self, new: np.ndarray) -> None:
        both = np.concatenate([self.at, new], 1)
        both = both[:, np.lexsort((both[2], -both[3], both[1], both[0]))]
        group = both[0] * self.bands + both[1]
        first = np.flatnonzero(np.append(True, np.diff(group) > 0)) if len(group) else np.empty(0, np.int64)
        place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
        self.at = both[:, place < self.k]


def kth_largest(x: np.ndarray, k: int) -> np.ndarray:
    """Per column, or OPEN where there are fewer."""
    return np.partition(x, len(x) - k, 0)[len(x) - k] if len(x) >= k else np.full(x.shape[1], OPEN)


def survivors(rows: Planes, q: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the pairs that may be among the first k in a band; exact scores.

    allowed: pairs that count. low, high, known: per anchor and band its ends, and the k-th score that is known already.
    """
    up, down = np.maximum(q, 0).sum(1), np.minimum(q, 0).sum(1)
    kind = exact_type(rows.bits + 1, q)
    factors = q.astype(kind)
    known = np.maximum(low, known)
    open_planes = max(0, rows.bits - 2 * PLANES + 1)
    part = np.rint(rows.first(open_planes).astype(kind) @ factors.T).astype(np.int64) << open_planes
    i = j = None  # the pairs that are left, once they are few
    while True:
        rest = (1 << open_planes) - 1
        if i is None:
            least, most = part + down * rest, part + up * rest
            keep = np.zeros(part.shape, bool)
            for b in range(low.shape[1]):
                sure = np.where(allowed & (least >= low[:, b]) & (most <= high[:, b]), least, OPEN)
                floor = np.maximum(known[:, b], kth_largest(sure, k))
                keep |= (most >= floor) & (least <= high[:, b])
            allowed = allowed & keep
            if np.count_nonzero(allowed) * DENSE < allowed.size or not open_planes:
                i, j = np.nonzero(allowed)
                part = part[i, j]
        else:
            least, most, keep = part + down[j] * rest, part + up[j] * rest, np.zeros(len(i), bool)
            for b in range(low.shape[1]):
                keep |= (most >= known[j, b]) & (least <= high[j, b])
            i, j, part = i[keep], j[keep], part[keep]
        if not open_planes:
            return i, j, part
        top, open_planes = open_planes, max(0, open_planes - PLANES)
        digits = rows.next(top, open_planes).astype(kind)
        if i is None:
            part += np.rint(digits @ factors.T).astype(np.int64) << open_planes
        else:
            for at in range(0, len(i), PAIRS):
                s = slice(at, at + PAIRS)
                part[s] += np.rint(np.einsum("pd,pd->p", digits[i[s]], factors[j[s]])).astype(np.int64) << open_planes


def first_in_bands(rows: DataFrame, ids: np.ndarray, labels: np.ndarray, q: list[np.ndarray], low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(anchor, band, vec_id, score): per anchor (its place in ids, labels, q) and band the first k rows of its label, or of
    other labels, whose score is in the band, of each task's rows."""
    held = rows.sparkSession.sparkContext.broadcast((ids, labels, q, low, high))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, q, low, high = held.value
        found = Found(len(ids), low.shape[1], k)
        length = np.array([len(x) for x in q])
        wanted = (low <= high).any(1)
        blocks = []
        for n in np.unique(length[wanted]):
            of = np.flatnonzero(wanted & (length == n))
            of = of[np.argsort(labels[of], kind="stable")] if same else of
            cuts = [*np.flatnonzero(np.diff(labels[of])) + 1] if same else []
            blocks += [(int(n), part[at : at + ANCHORS]) for part in np.split(of, cuts) for at in range(0, len(part), ANCHORS)]
        matrix = {of[0]: np.array([q[a] for a in of], np.int64).reshape(len(of), n) for n, of in blocks}
        for batch in batches:
            size = np.array(batch.column("v").value_lengths().to_numpy(zero_copy_only=False))
            flat, ends = batch.column("v").flatten().to_numpy(zero_copy_only=False), np.cumsum(size)
            vec, lab = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
            for n in np.unique(size):
                every = np.flatnonzero(size == n)
                for at in range(0, len(every), ROWS):
                    tile = every[at : at + ROWS]
                    v = flat[(ends[tile] - n)[:, None] + np.arange(n)].astype(np.int64).reshape(len(tile), n)
                    whole, known, made = Planes(v), found.least(), []
                    for _, of in (b for b in blocks if b[0] == n):
                        planes, own = whole, tile
                        if same:
                            mine = np.flatnonzero(lab[tile] == labels[of[0]])
                            planes, own = Planes(v[mine]), tile[mine]
                        if not len(own):
                            continue
                        allowed = vec[own][:, None] != ids[of][None]
                        if not same:
                            allowed &= lab[own][:, None] != labels[of][None]
                        i, j, s = survivors(planes, matrix[of[0]], allowed, low[of], high[of], known[of], k)
                        for b in range(low.shape[1]):
                            ok = (s >= low[of[j], b]) & (s <= high[of[j], b]) & (s >= known[of[j], b])
                            made.append(np.array([of[j[ok]], np.full(ok.sum(), b), vec[own[i[ok]]], s[ok]], np.int64))
                    if made:
                        found.add(np.concatenate(made, 1))
        a, b, v, s = found.at
        yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(v), pa.array(s)], names=["anchor", "band", "vec_id", "score"])

    out = rows.mapInArrow(run, FOUND)
    order = Window.partitionBy("anchor", "band").orderBy(F.desc("score"), "vec_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(
    df: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = 4096,
) -> DataFrame:
    """SCHEMA: for each row of df (vec_id, label, embedding) whose id is divisible by `every`, and each of its `positives`
    nearest rows of the same label, the first `negatives` rows of other labels that score between low and high percent of
    the positive. block: anchors that are answered at once.
    """
    spark = prepare(df.sparkSession)
    stored = Stored(integers(df, scale))
    rows = stored.df
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("a")).select("vec_id", "a.*")
    anchors = shared(anchors)
    n_blocks = max(1, -(-anchors.count() // (block // 2)))
    anchors = anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)))
    folder = f"{shared_folder(spark)}/mined-{uuid.uuid4().hex}"
    for at in range(n_blocks):
        got = anchors.where(F.col("block") == at).orderBy("vec_id").select("vec_id", "label", "v").collect()
        if not got:
            continue
        ids, labels, q = np.array([r.vec_id for r in got], np.int64), np.array([r.label for r in got], np.int64), [np.array(r.v, np.int64) for r in got]
        any_score = np.iinfo(np.int64).max
        near = first_in_bands(rows, ids, labels, q, np.full((len(ids), 1), OPEN + 1), np.full((len(ids), 1), any_score), positives, same=True).collect()
        score, positive = np.zeros((len(ids), positives), np.int64), np.zeros((len(ids), positives), np.int64)
        least, most = np.full(score.shape, any_score), np.full(score.shape, OPEN)
        for r in near:
            p = (r.anchor, r.rank - 1)
            score[p], positive[p], least[p], most[p] = r.score, r.vec_id, -(-low * r.score // 100), high * r.score // 100
        chosen = first_in_bands(rows, ids, labels, q, least, most, negatives, same=False)
        named = spark.createDataFrame([(r.anchor, r.rank - 1, int(ids[r.anchor]), r.vec_id, r.score) for r in near], "anchor int, band int, anchor_id long, positive_id long, positive_score long")
        out = chosen.join(F.broadcast(named), ["anchor", "band"])  # of block * positives rows at most
        out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(folder)
    stored.drop()
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(folder)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every 50th embedding."""
    df = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(df.select("vec_id", label.alias("label"), "embedding"))


NEGATIVES_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256*x::double)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from v a join v b on a.vec_id % 50 = 0 and a.vec_id != b.vec_id),
p as (select * from pairs where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5),
n as (select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor_id, p.other_id order by pairs.score desc, pairs.other_id) as rank,
  pairs.other_id as negative_id, p.score as positive_score, pairs.score as negative_score
  from p join pairs on p.anchor_id = pairs.anchor_id and not pairs.same and 50*p.score <= 100*pairs.score and 100*pairs.score <= 95*p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""
