"""The vectors of a weighted least squares problem on group effects as DataFrames.

Rows are cells: distinct combinations of keys and slopes with their summed weight. Column l of effect k is the slope times
the root of the weight, at right angles to the others of its key, and of length 1. All spaces do the same arithmetic, so LSMR takes the same steps in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorbus.operators.graph import Stored, shared
from sorbus.plans.blocks import roots

BROADCAST_BYTES = 8 << 20  # of a table that passes the driver on its way to all executors


def bytes_of(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes about) of a table, by one aggregation: eight bytes a column, texts and binaries by their length."""
    wide = [F.sum(F.octet_length(f"`{f.name}`").cast("double")) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, *sizes = df.agg(F.count("*"), *wide).first()
    return n, int(n * 8 * len(df.columns) + sum(x or 0 for x in sizes))


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", size: int | None = None) -> DataFrame:
    """df with the columns of table by its keys; table goes to all executors if it has at most BROADCAST_BYTES."""
    small = (bytes_of(table)[1] if size is None else size) <= BROADCAST_BYTES
    return df.join(F.broadcast(table) if small else table, keys, how)


def level_roots(rows: DataFrame, keys: list[str], x: list[Column], weight: str) -> DataFrame:
    """keys and __r{p}_{q}: per level the matrix that makes the columns x, times the weight's root, orthonormal; of one
    column, 1 over the root of its weighted squares, or 0."""
    n = len(x)
    if n == 1:
        ss = rows.groupBy(*keys).agg(F.sum(F.col(weight) * x[0] * x[0]).alias("__ss"))
        return ss.select(*keys, F.when(F.col("__ss") > 0, 1 / F.sqrt(F.when(F.col("__ss") > 0, F.col("__ss")))).otherwise(0.0).alias("__r0_0"))
    pairs = [(a, b) for a in range(n) for b in range(a + 1)]
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(weight) * x[a] * x[b]).alias(f"__g{a}_{b}") for a, b in pairs])
    names = [f"__r{p}_{q}" for p in range(n) for q in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = np.empty((batch.num_rows, n, n))
            for a, b in pairs:
                gram[:, a, b] = gram[:, b, a] = batch.column(f"__g{a}_{b}").to_numpy(zero_copy_only=False)
            root = roots(gram)[0].reshape(-1, n * n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *[pa.array(c) for c in root.T.copy()]], names=[*keys, *names])

    kinds = [*[sums.schema[c] for c in keys], *[T.StructField(c, T.DoubleType()) for c in names]]
    return sums.mapInArrow(run, T.StructType(kinds))


def level_roots(rows: DataFrame, keys: list[str], x: list[Column], weight: str) -> DataFrame:
    """keys and __r{p}_{q}: per level the matrix that makes the columns x, times the weight's root, orthonormal; of one
    column, 1 over the root of its weighted squares, or 0."""
    n = len(x)
    if n == 1:
        ss = rows.groupBy(*keys).agg(F.sum(F.col(weight) * x[0] * x[0]).alias("__ss"))
        return ss.select(*keys, F.when(F.col("__ss") > 0, 1 / F.sqrt(F.when(F.col("__ss") > 0, F.col("__ss")))).otherwise(0.0).alias("__r0_0"))
    pairs = [(a, b) for a in range(n) for b in range(a + 1)]
    sums = rows.groupBy(*keys).agg(*[F.sum(F.col(weight) * x[a] * x[b]).alias(f"__g{a}_{b}") for a, b in pairs])
    names = [f"__r{p}_{q}" for p in range(n) for q in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gram = np.empty((batch.num_rows, n, n))
            for a, b in pairs:
                gram[:, a, b] = gram[:, b, a] = batch.column(f"__g{a}_{b}").to_numpy(zero_copy_only=False)
            root = roots(gram)[0].reshape(-1, n * n)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keys], *[pa.array(c) for c in root.T.copy()]], names=[*keys, *names])

    kinds = [*[sums.schema[c] for c in keys], *[T.StructField(c, T.DoubleType()) for c in names]]
    return sums.mapInArrow(run, T.StructType(kinds))


class TableSpace:
    """DataFrames. u is a column per outcome beside the design; v, h, h-bar and x are columns of a level table per effect.

    A round is a join per effect and a pass over the rows, then a grouped sum per effect; only sums of squares come to the
    driver. The vectors are written to the shared folder, so a lost executor costs no round, and deleted when the next
    ones are there: at most two versions of them take space.
    """

    def __init__(self, cells: DataFrame, groups: list[tuple[list[str], dict[int, Column]]], weight: str, b: list[Column], warm: bool, kind: str = "double"):
        """groups: key columns and, by the effect's number, what each effect of that key multiplies."""
        self.m, self.kind, self.warm = len(b), kind, warm
        self.stored: dict[int, Stored] = {}
        self.olds: list[Stored | None] = []
        n = sum(len(g) for _, g in groups)
        self.groups, self.roots = groups, []
        self.keys: list[list[str]] = [[]] * n
        self.all_keys = list(dict.fromkeys(k for keys, _ in groups for k in keys))
        design, self.levels, self.size = cells, [None] * n, [0] * n
        for keys, effects in groups:
            table = shared(level_roots(cells, keys, list(effects.values()), weight))
            rows, size = bytes_of(table)
            self.roots.append(table)
            design = looked_up(design, table, keys, size=size)
            for q, k in enumerate(effects):
                self.keys[k], self.levels[k], self.size[k] = keys, table.select(*keys), size + 8 * rows * self.m
                turned = sum((x * F.col(f"__r{p}_{q}") for p, x in enumerate(effects.values())), F.lit(0.0))
                design = design.withColumn(f"__c{k}", turned * F.sqrt(weight))
            design = design.drop(*[c for c in table.columns if c not in keys])
        u = [F.coalesce(c, F.lit(0.0)).alias(f"__u{i}") for i, c in enumerate(b)]
        self.held = self.levels  # what self.levels are made from
        self.rows = shared(design.select(*self.all_keys, *[f"__c{k}" for k in range(n)], *u))
        self.u_scale, self.v_scale = [1.0] * self.m, [1.0] * self.m

    def hold(self, df: DataFrame, old: DataFrame) -> DataFrame:
        """df, written; what `old` was read from goes in then()."""
        new = Stored(df)
        self.olds.append(self.stored.pop(id(old), None))
        self.stored[id(new.df)] = new
        return new.df

    def then(self) -> None:
        for old in self.olds:
            if old is not None:
                old.drop()
        self.olds = []

    def lengths(self, tables: list[DataFrame], columns: list[str]) -> list[float]:
        """Roots of the summed squares of columns over all tables, in one job."""
        sums = None
        for t in tables:
            one = t.agg(*[F.sum(F.col(c).cast("double") * F.col(c)).alias(c) for c in columns])
            sums = one if sums is None else sums.union(one)
        row = sums.agg(*[F.sum(c) for c in columns]).first()
        return [math.sqrt(x or 0.0) for x in row]

    def num(self, x: Column) -> Column:
        return x.cast(self.kind)

    def product(self, which: list[int], column: str, scale: list[float], old: list[float]) -> list[float]:
        """u := A (scale column) + old u, unscaled; its lengths."""
        rows = self.rows
        for k, (keys, t) in enumerate(zip(self.keys, self.levels, strict=True)):
            rows = looked_up(rows, t.select(*keys, *[F.col(f"{column}{i}").alias(f"__t{k}_{i}") for i in which]), keys, size=self.size[k])
        new = {i: self.num(sum((F.col(f"__c{k}") * F.col(f"__t{k}_{i}") for k in range(len(self.keys))), F.lit(0.0)) * F.lit(s) + F.lit(o) * F.col(f"__u{i}")).alias(f"__u{i}") for i, s, o in zip(which, scale, old, strict=True)}
        rows = rows.select(*self.all_keys, *[f"__c{k}" for k in range(len(self.keys))], *[new.get(i, F.col(f"__u{i}")) for i in range(self.m)])
        self.rows = self.hold(rows, self.rows)
        out = self.lengths([self.rows], [f"__u{i}" for i in which])
        self.then()
        return out

    def transposed(self, which: list[int], old: list[float], into: str = "__v", rest: tuple[str, ...] = ()) -> list[float]:
        """into := A'u + old into, unscaled; its lengths."""
        tables = []
        for k, (keys, t) in enumerate(zip(self.keys, self.levels, strict=True)):
            sums = self.rows.groupBy(*keys).agg(*[F.sum(F.col(f"__c{k}") * F.col(f"__u{i}") * F.lit(self.u_scale[i])).alias(f"__g{i}") for i in which])
            both = t.join(sums, keys)
            new = {f"{into}{i}": self.num(F.col(f"__g{i}") + (F.lit(o) * F.col(f"{into}{i}") if f"{into}{i}" in t.columns else 0.0)).alias(f"{into}{i}") for i, o in zip(which, old, strict=True)}
            kept = [new.pop(c, F.col(c)) for c in t.columns]
            tables.append(self.hold(both.select(*kept, *new.values()), self.held[k]))
        out = self.lengths(tables, [f"{into}{i}" for i in which])
        self.levels, self.held = tables, tables
        self.then()
        return out

    def start(self):
        every = list(range(self.m))
        if self.warm:
            self.transposed(every, [0.0] * self.m, "__x")
            beta = self.product(every, "__x", [-1.0] * self.m, [1.0] * self.m)
        else:
            self.levels = [t.select("*", *[F.lit(0.0).cast(self.kind).alias(f"__x{i}") for i in every]) for t in self.levels]
            beta = self.lengths([self.rows], [f"__u{i}" for i in every])
        self.u_scale = [1 / x if x else 1.0 for x in beta]
        alpha = self.transposed(every, [0.0] * self.m)
        self.v_scale = [1 / x if x else 1.0 for x in alpha]
        self.levels = [t.select("*", *[self.num(F.col(f"__v{i}") * F.lit(self.v_scale[i])).alias(f"__h{i}") for i in every], *[F.lit(0.0).cast(self.kind).alias(f"__b{i}") for i in every]) for t in self.levels]
        return beta, alpha

    def left(self, which, alpha):
        beta = self.product(which, "__v", [self.v_scale[i] for i in which], [-a * self.u_scale[i] for i, a in zip(which, alpha, strict=True)])
        for i, x in zip(which, beta, strict=True):
            self.u_scale[i] = 1 / x if x else 1.0
        return beta

    def right(self, which, beta):
        alpha = self.transposed(which, [-b * self.v_scale[i] for i, b in zip(which, beta, strict=True)])
        for i, x in zip(which, alpha, strict=True):
            self.v_scale[i] = 1 / x if x else 1.0
        return alpha

    def advance(self, which, keep, move, turn):
        tables = []
        for t in self.levels:
            new = {}
            for i, k, m, r in zip(which, keep, move, turn, strict=True):
                bar = F.col(f"__h{i}") - F.lit(k) * F.col(f"__b{i}")
                new |= {f"__b{i}": bar, f"__x{i}": F.col(f"__x{i}") + F.lit(m) * bar, f"__h{i}": F.col(f"__v{i}") * F.lit(self.v_scale[i]) - F.lit(r) * F.col(f"__h{i}")}
            tables.append(t.select(*[self.num(new[c]).alias(c) if c in new else F.col(c) for c in t.columns]))
        self.levels = tables  # written with the next v
        return self.lengths(tables, [f"__x{i}" for i in which])

    def end(self) -> list[tuple[DataFrame, int]]:
        """Per key its columns and __b{k}_{i}, the coefficient of effect k and outcome i; and the table's bytes."""
        out = []
        for (keys, effects), table in zip(self.groups, self.roots, strict=True):
            for q, k in enumerate(effects):
                table = table.join(self.levels[k].select(*keys, *[F.col(f"__x{i}").alias(f"__z{q}_{i}") for i in range(self.m)]), keys)
            value = lambda p, i, n=len(effects): sum((F.col(f"__r{p}_{q}") * F.col(f"__z{q}_{i}") for q in range(n)), F.lit(0.0))
            made = shared(table.select(*keys, *[value(p, i).cast("double").alias(f"__b{k}_{i}") for p, k in enumerate(effects) for i in range(self.m)]))
            out.append((made, bytes_of(made)[1]))
        self.drop()
        return out

    def drop(self) -> None:
        """Deletes the written vectors."""
        self.olds = list(self.stored.values())
        self.stored = {}
        self.then()
