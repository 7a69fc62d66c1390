"""Connected components of an edge table by forests within partitions and large-star and small-star rounds; shared folders."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 20  # edges that end in one task
FOREST = 1 << 18  # edges that each task makes a forest of together: some 50 MB of its Python, however many it has
HOT = 100_000  # edges to one node beyond which it is looked up apart


def shared_folder(spark: SparkSession) -> str:
    """The folder in which lineage is cut: the one that ``spark.checkpoint.dir`` names.

    Where the session names none, a local session (as in tests) gets a folder of this machine, and a cluster an error,
    for its executors don't see each other's disks.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or "/tmp/checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


def shared(df: DataFrame) -> DataFrame:
    """df cut from its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


class Stored:
    """A table written in the shared folder, compressed, and its DataFrame; drop() when nothing will read it any more."""

    def __init__(self, df: DataFrame):
        self.spark = df.sparkSession
        self.path = f"{shared_folder(self.spark)}/stored-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files and checkpoints that nothing refers to any more, rather than at its next rest."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def forest(edges: DataFrame, chunk: int | None = None) -> DataFrame:
    """Edges (src, dst) that connect what `edges` connect, at most one per node and chunk: each chunk of a partition's edges
    becomes stars around the least node of each of its components. No edge moves."""
    chunk = min(CHUNK, FOREST) if chunk is None else chunk

    def stars(src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        u, v = at[: len(src)], at[len(src) :]
        root = np.arange(len(nodes))
        while True:
            a, b = root[u], root[v]
            least = np.minimum(a, b)
            np.minimum.at(root, a, least)  # of two roots that an edge joins, the greater hangs below the less
            np.minimum.at(root, b, least)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            open_ = root[u] != root[v]
            if not open_.any():
                break
            u, v = u[open_], v[open_]
        below = np.flatnonzero(root != np.arange(len(nodes)))
        return nodes[below], nodes[root[below]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        n = 0

        def made() -> pa.RecordBatch:
            src, dst = stars(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
            return pa.RecordBatch.from_arrays([pa.array(src, kind), pa.array(dst, kind)], names=["src", "dst"])

        for batch in batches:
            kind = batch.schema.field("src").type
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("src", "dst")))
            n += batch.num_rows
            if n >= chunk:
                out = made()
                held, n = [], 0
                yield out
        if n:
            yield made()

    return edges.select("src", "dst").mapInArrow(run, edges.select("src", "dst").schema)


def least_neighbours(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.min("dst").alias("m"))


def hung_lower(edges: DataFrame, hot: int) -> DataFrame:
    """(src, dst): each edge's dst replaced by the least node that hangs it, if any does. A dst with more than `hot` edges,
    of which there are few, is looked up by a broadcast, so its edges stay where they are."""
    low = least_neighbours(edges).select(F.col("src").alias("dst"), "m")
    busy = edges.groupBy("dst").count().where(F.col("count") > hot).select("dst")
    busy = shared(busy.join(low, "dst", "left").withColumn("busy", F.lit(True)))
    marked = edges.join(F.broadcast(busy), "dst", "left")  # edges / hot rows at most
    rest = marked.where("busy is null").select("src", "dst").join(low, "dst", "left")
    out = marked.where("busy").select("dst", "src", "m").union(rest.select("dst", "src", "m"))
    return out.select("src", F.coalesce("m", "dst").alias("dst"))


def connected_components(edges: DataFrame, hot: int | None = None) -> DataFrame:
    """(node, component): component is the least node that `edges` (src, dst) connect to; both of one orderable type.

    Loops, repeated and reversed edges count once; rows with a null end are ignored; an empty table gives no rows.

    Edges are reduced to forests where they lie, before anything is shuffled: of a node, each chunk keeps one edge. If they
    were one chunk, that is all. Else rounds follow, of large stars, small stars and forests again, until one changes nothing.
    A hub's edges lead to it after a forest, from nodes that are told apart, so only lookups by dst can meet one.
    """
    hot = HOT if hot is None else hot
    e = edges.select("src", "dst").where("src is not null and dst is not null")
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    e = shared(forest(e.where("src != dst")))
    n = e.count()
    if n <= CHUNK:
        e = shared(forest(e.coalesce(1), CHUNK))
    before = None
    while n > CHUNK:
        large = hung_lower(e, hot).where("src != dst").distinct()
        small = large.join(least_neighbours(large), "src")
        pair = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
        both = small.select(F.explode(F.array(pair("src", "m"), pair("dst", "m"))).alias("x")).select("x.*")
        e = shared(forest(both.where("src != dst").distinct()))
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return nodes.join(least_neighbours(e).withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("m", "node").alias("component"))
