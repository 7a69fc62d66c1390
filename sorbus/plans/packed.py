"""LSMR's vectors over the levels alone, of rows that the driver holds or of a design stored as blocks of arrays.

In such a design rows never move again, and no round writes any.

Levels are numbered once. The rows, dealt by ranges of their codes (or, if levels are few, left where they lie) and sorted a
few blocks at a time, are packed into blocks of at most BLOCK rows: an array of codes per key, an array per slope, weight and
outcome. A code with many rows spreads over blocks and partitions, so no task grows with a level.

A round is one pass over the blocks for all effects and outcomes: each task gathers the levels' values, multiplies, and sums
into levels again, in bounded memory; what it has summed travels by segments of SEGMENT levels, of which only those that it
touched, and is summed by segment. The levels' vectors, 8 bytes a level, effect and outcome each, are arrays of the driver
and are broadcast; the caller measures them first. u is not stored at all: LSMR needs its length and A'u, and both follow
from A'A v and the length of A v, as u's own recurrence says. In exact arithmetic the steps are those of the other spaces.

The effect with the most levels may be eliminated: rows are then dealt and sorted so that each of its levels lies in one block,
every product takes the rows' projection on them away there, and the driver has vectors of the other effects only.
"""

from __future__ import annotations

import math
import os
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.operators.graph import Stored, shared
from sorbus.plans.blocks import CUTOFF, roots

BLOCK, SEGMENT = 1 << 16, 1 << 14
READ = 4  # blocks or segments that a task's Python reads together, of some MB: else what it holds grows with its partition
TASK, LEAST = 16, 4096  # blocks of a task at most, and rows of one at least, of large and small designs
CHUNK_BLOCKS, FEWER = 4, 4  # blocks that are sorted together; rows per level and task from which rows stay where they lie
NOISE = 1e-13  # share of the squared length of A v below which what is left of it is rounding
LOST = 1e-12  # share of A'A v below which what is left of it is rounding
RESTARTS = 5
HELD = 12  # of the last v, to which a new one is made orthogonal
EXACT = 1e-13  # of the first residual: what is left is rounding, and has no slope
UNSOLVED = 1e-9  # a slope of the residual itself that no rounding explains


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df, written, with dense numbers from 0: its partitions are counted, and each begins where the ones before it end."""
    held = shared(df.withColumn("__id", F.monotonically_increasing_id()))
    counts = sorted((r.p, r.n) for r in held.groupBy(F.shiftright("__id", 33).alias("p")).agg(F.count("*").alias("n")).collect())
    before = np.concatenate([[0], np.cumsum([n for _, n in counts])]).tolist()
    starts = held.sparkSession.createDataFrame([(p, b - (p << 33)) for (p, _), b in zip(counts, before, strict=False)], "__p long, __by long")
    out = held.withColumn("__p", F.shiftright("__id", 33)).join(F.broadcast(starts), "__p")  # a row per partition
    return out.withColumn(name, F.col("__id") + F.col("__by")).drop("__id", "__p", "__by")


def merged_cells(columns: list[np.ndarray], summed: list[bool]) -> list[np.ndarray]:
    """Neighbouring rows that differ in summed columns only become one."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c, s in zip(columns, summed, strict=True):
        if not s:
            new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return columns if len(at) == len(new) else [np.add.reduceat(c, at) if s else c[at] for c, s in zip(columns, summed, strict=True)]


def packed(rows: DataFrame, codes: list[str], numbers: list[str], sums: tuple[str, ...] = (), levels: int | None = None, whole: bool = False) -> Stored:
    """Blocks of rows: n, and per column its values as binary: 32-bit codes, 64-bit floats.

    Of numbers in `sums`, rows that agree in all others are added up, as far as they lie in one run of CHUNK_BLOCKS blocks.
    Rows are dealt by ranges of their codes, so that a task's sums are of few levels; unless there are so few levels, of all
    keys, that every task may have sums of them all: then rows are packed where they lie.

    whole: all rows of a level of the first code lie in one block, however many; the caller knows that no level has too many.
    """
    names = [*codes, *numbers]
    kinds = dict.fromkeys(codes, np.dtype("<i4")) | dict.fromkeys(numbers, np.dtype("<f8"))
    summed = [c in sums for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        count, most = 0, CHUNK_BLOCKS * BLOCK

        def made(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, count
            chunk = [np.concatenate([h[i] for h in held]) for i in range(len(names))]
            held, count = [], 0
            if whole and not last:  # rows come sorted, and those of the last level may go on
                keep = int(np.searchsorted(chunk[0], chunk[0][-1]))
                held, count = [[x[keep:] for x in chunk]], len(chunk[0]) - keep
                chunk = [x[:keep] for x in chunk]
            order = np.lexsort(chunk[: len(codes)][::-1])
            chunk = [x[order] for x in chunk]
            chunk = merged_cells(chunk, summed) if sums else chunk
            at = 0
            while at < len(chunk[0]):
                end = at + BLOCK
                if whole and end < len(chunk[0]):
                    end = int(np.searchsorted(chunk[0], chunk[0][end - 1], "right"))
                part = [x[at:end] for x in chunk]
                at = end
                yield pa.RecordBatch.from_arrays([pa.array([len(part[0])], pa.int32()), *[pa.array([x.astype(kinds[c]).tobytes()], pa.binary()) for x, c in zip(part, names, strict=True)]], names=["n", *names])

        for batch in batches:
            held.append([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            count += batch.num_rows
            if count >= most:
                yield from made(False)
                most = max(CHUNK_BLOCKS * BLOCK, 2 * count)
        if count:
            yield from made(True)

    plain, cores = rows.select(*names), rows.sparkSession.sparkContext.defaultParallelism
    seen = plain.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).agg(F.count("*"), F.sum("n"), F.max("n")).first()
    n = seen[1] or 0
    parts = max(1, n // (TASK * BLOCK), min(cores, n // LEAST))  # a number, so Spark doesn't merge what is to be spread
    even = seen[0] >= min(parts, cores) and seen[2] * min(seen[0], cores) <= 2 * n
    if whole:
        plain = plain.repartitionByRange(parts, codes[0]).sortWithinPartitions(*codes)
    elif levels is None or not even or levels * seen[0] > n // FEWER:
        plain = plain.repartitionByRange(parts, *codes)
    return Stored(plain.mapInArrow(run, ", ".join(["n int", *[f"{c} binary" for c in names]])))


@dataclass
class Term:
    """An effect in a packed design: its column of codes, its slope's column if any, and its place among the key's effects."""

    code: str
    slope: str | None
    place: int


def blocks_of(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[dict[str, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {c: np.frombuffer(batch.column(c)[i].as_buffer(), "<i4" if c[0] == "c" else "<f8") for c in columns}


@contextmanager
def few_at_once(spark: SparkSession) -> Iterator[None]:
    """Jobs begun inside hand READ rows at a time to Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, READ)
    try:
        yield
    finally:
        spark.conf.set(key, before)


class Pass:
    """One pass over the blocks: per block some vectors over levels, summed over all blocks, and a few numbers besides."""

    def __init__(self, blocks: DataFrame, columns: list[str], sizes: list[int], extra: int):
        self.blocks, self.columns, self.sizes, self.extra = blocks, columns, sizes, extra

    def run(self, kernel, held: object = None) -> tuple[list[np.ndarray], np.ndarray]:
        """kernel(block, held) yields (which, codes, values) to be summed by code, and (-1, place, number)."""
        spark, edges, columns, extra = self.blocks.sparkSession, np.concatenate([[0], np.cumsum(self.sizes)]).astype(int), self.columns, self.extra
        sent = spark.sparkContext.broadcast(held)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, numbers, touched = np.zeros(edges[-1]), np.zeros(extra), np.zeros(edges[-1] // SEGMENT + 1, bool)
            for block in blocks_of(batches, columns):
                for which, at, values in kernel(block, sent.value):
                    if which < 0:
                        numbers[at] += values
                    elif len(at):
                        low = int(at.min())
                        sums = np.bincount(at - low, values)
                        begin = edges[which] + low
                        total[begin : begin + len(sums)] += sums
                        touched[begin // SEGMENT : (begin + len(sums) - 1) // SEGMENT + 1] = True
            segments = np.flatnonzero(touched).tolist()
            sums = [total[s * SEGMENT : (s + 1) * SEGMENT].tobytes() for s in segments]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *segments], pa.int32()), pa.array([numbers.tobytes(), *sums], pa.binary())], names=["segment", "sums"])

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[int, np.ndarray] = {}
            for batch in batches:
                for s, b in zip(batch.column("segment").to_pylist(), batch.column("sums"), strict=True):
                    x = np.frombuffer(b.as_buffer())
                    found[s] = found[s] + x if s in found else x
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([x.tobytes() for x in found.values()], pa.binary())], names=["segment", "sums"])

        kind = "segment int, sums binary"
        with few_at_once(spark):
            got = self.blocks.select(*columns).mapInArrow(part, kind).repartition("segment").mapInArrow(merged, kind).collect()
        sent.destroy()
        total, numbers = np.zeros(edges[-1]), np.zeros(extra)
        for r in got:
            if r.segment < 0:
                numbers = np.frombuffer(r.sums)
            else:
                x = np.frombuffer(r.sums)
                total[r.segment * SEGMENT : r.segment * SEGMENT + len(x)] = x
        return [total[a:b] for a, b in zip(edges, edges[1:], strict=False)], numbers


class LevelSpace:
    """LSMR's v, h, h-bar and x over the levels of all effects; u is not stored, but where a space has its own steps.

    What u's recurrence gives without u has lost the digits by which A v and alpha u agree. So lengths that rounding alone could
    have made are 0, which ends the solve; and restarted() tells, from the residual itself, whether it is solved.

    terms: the effects; levels: per column of codes how many; grams: per column its levels' Gram matrices, by which effects
    that share it are made orthogonal, level by level (blocks.roots). A solve begins from A'b if warm, else from 0.
    """

    def __init__(self, terms: list[Term], levels: dict[str, int], outcomes: int, grams: dict[str, np.ndarray], warm: bool):
        self.terms, self.levels, self.n_outcomes, self.warm = terms, levels, outcomes, warm
        self.groups = {c: [k for k, t in enumerate(terms) if t.code == c] for c in levels}
        self.sizes = [levels[t.code] for t in terms]
        self.edges = np.concatenate([[0], np.cumsum(self.sizes)]).astype(int)
        self.roots = {c: roots(g)[0] for c, g in grams.items()}
        self.begun, self.largest, self.best, self.length = None, 0.0, [None] * outcomes, None

    def products(self, which: list[int], values: list[np.ndarray], rest: bool) -> tuple[list[np.ndarray], list[float]]:
        """Per outcome in `which` A'r and r's squared length, where r is b - A z (rest) or A z, in one pass for all."""
        raise NotImplementedError

    def level_product(self, z: np.ndarray, turned: bool) -> np.ndarray:
        """Per level the matrix of its root, or its transpose, times the key's effects' values."""
        out = np.empty_like(z)
        for c, of in self.groups.items():
            root = self.roots[c]
            if len(of) == 1:
                a, b = self.edges[of[0]], self.edges[of[0] + 1]
                np.multiply(z[a:b], root[:, 0, 0], out=out[a:b])
                continue
            x = np.stack([z[self.edges[k] : self.edges[k + 1]] for k in of], 1)
            x = np.einsum("lqp,lq->lp" if turned else "lpq,lq->lp", root, x)
            for j, k in enumerate(of):
                out[self.edges[k] : self.edges[k + 1]] = x[:, j]
        return out

    def start(self):
        every, zero = list(range(self.n_outcomes)), np.zeros(self.edges[-1])
        self.x = self.begun or [zero.copy() for _ in every]
        if self.warm:
            self.x = self.products(every, self.x, True)[0]
        back, squares = self.products(every, self.x, True)
        self.beta = [math.sqrt(s) for s in squares]
        self.length = self.length or list(self.beta)
        self.v = [g / b if b else g for g, b in zip(back, self.beta, strict=True)]
        self.alpha = [float(np.linalg.norm(v)) for v in self.v]
        self.v = [v / a if a else v for v, a in zip(self.v, self.alpha, strict=True)]
        self.best = [b or (a, x.copy()) for b, a, x in zip(self.best, self.alpha, self.x, strict=True)]
        self.before = [zero.copy() for _ in every]
        self.h, self.bar, self.back = [v.copy() for v in self.v], [zero.copy() for _ in every], [zero for _ in every]
        self.held = [deque([v], HELD) for v in self.v]
        return list(self.beta), list(self.alpha)

    def left(self, which, alpha):
        """A v - alpha u is at right angles to u, so its squared length is that of A v less alpha squared."""
        back, squares = self.products(which, [self.v[i] for i in which], False)
        out = []
        for i, a, g, s in zip(which, alpha, back, squares, strict=True):
            self.back[i], self.largest = g, max(self.largest, math.sqrt(s))
            left = s - a * a
            out.append(math.sqrt(left) if left > NOISE * s else 0.0)
        return out

    def restarted(self, atol: float) -> list[int]:
        """A solve may begin again from x: start() will. The outcomes whose residual r has an A'r of more than atol times the
        lengths of r and of A, whose estimate is the largest A v seen: their slope. An x that made it worse is given up for the
        one before."""
        every = list(range(self.n_outcomes))
        back, squares = self.products(every, self.x, True)
        exact = [EXACT * b for b in self.length]
        slopes = [float(np.linalg.norm(g)) / math.sqrt(s) if s > e * e else 0.0 for g, s, e in zip(back, squares, exact, strict=True)]
        self.worse = False
        for i, x in enumerate(self.x):
            if slopes[i] <= self.best[i][0]:
                self.best[i] = slopes[i], x.copy()
            else:
                self.worse = True
        self.slopes = [b[0] / self.largest if self.largest else 0.0 for b in self.best]
        self.warm, self.x = False, [b[1].copy() for b in self.best]
        self.begun = self.x
        return [i for i in every if self.slopes[i] > atol]

    def right(self, which, beta):
        """A' of the new u is (A'A v - alpha A' of the old u) / beta, and A' of the old u is alpha v + its beta v before."""
        out = []
        for i, b in zip(which, beta, strict=True):
            v, a, new, before = self.v[i], self.alpha[i], self.back[i], self.before[i]
            rounding = LOST * math.sqrt(float(new @ new)) / b if b else 0.0
            if b:
                before *= -a * self.beta[i] / b
                new /= b
                new += before
                np.multiply(v, a * a / b + b, out=before)
                new -= before
                for old in [*self.held[i], *self.held[i]]:  # else a short new v is what rounding left of the old ones
                    new -= float(old @ new) * old
            else:
                new = np.zeros_like(v)
            length = math.sqrt(float(new @ new))
            # The columns of a key are at right angles, so A is no longer than the root of the number of keys, and alpha not either.
            possible = rounding < length < 1.01 * math.sqrt(len(self.groups))
            self.before[i], self.beta[i], self.alpha[i] = v, b, length if possible else 0.0
            if self.alpha[i]:
                new /= self.alpha[i]
            self.v[i] = new
            self.held[i].append(new)
            out.append(self.alpha[i])
        return out

    def advance(self, which, keep, move, turn):
        out = []
        for i, k, m, t in zip(which, keep, move, turn, strict=True):
            bar, h, x = self.bar[i], self.h[i], self.x[i]
            bar *= -k
            bar += h
            x += m * bar
            h *= -t
            h += self.v[i]
            out.append(math.sqrt(float(x @ x)))
        return out

    def coefficients(self) -> list[list[np.ndarray]]:
        """Per outcome and effect the coefficients by code."""
        every = [self.level_product(x, False) for x in self.x]
        return [[b[a:e] for a, e in zip(self.edges, self.edges[1:], strict=False)] for b in every]


def gram_pairs(groups: dict[str, list[int]]) -> list[tuple[str, int, int]]:
    return [(c, a, b) for c, of in groups.items() for a in range(len(of)) for b in range(a + 1)]


def gram_matrices(groups: dict[str, list[int]], levels: dict[str, int], sums: list[np.ndarray]) -> dict[str, np.ndarray]:
    out = {c: np.empty((levels[c], len(of), len(of))) for c, of in groups.items()}
    for (c, a, b), x in zip(gram_pairs(groups), sums, strict=True):
        out[c][:, a, b] = out[c][:, b, a] = x
    return out


class CellSpace(LevelSpace):
    """Rows that one process holds, sorted by their first codes, in one part per core.

    codes, slopes: arrays by the terms' names; weight: an array of weights or None; b: one array per outcome, times the
    root of the weight. kind: of what is computed per row; sums over rows are of 64 bits.
    """

    def __init__(self, terms: list[Term], levels: dict[str, int], codes: dict[str, np.ndarray], slopes: dict[str, np.ndarray], weight: np.ndarray | None, b: list[np.ndarray], warm: bool, kind: type = np.float64, cores: int = 8):
        n = len(next(iter(codes.values())))
        cores = max(1, min(cores, os.cpu_count() or 1, n // 20_000))
        edge = np.linspace(0, n, cores + 1).astype(int).tolist()
        self.parts = []
        for lo, hi in zip(edge, edge[1:], strict=False):
            part = {"b": [x[lo:hi].astype(kind) for x in b], "root": None if weight is None else np.sqrt(weight[lo:hi]).astype(kind), "codes": {}}
            for c, g in codes.items():
                low = int(g[lo:hi].min()) if hi > lo else 0
                part["codes"][c] = low, (g[lo:hi] - low).astype(np.intp)
            part["slopes"] = {s: x[lo:hi].astype(kind) for s, x in slopes.items()}
            self.parts.append(part)
        self.pool, self.kind = ThreadPoolExecutor(cores), kind
        groups = {c: [k for k, t in enumerate(terms) if t.code == c] for c in levels}
        sums = []
        for c, one, two in gram_pairs(groups):
            x = [slopes[terms[groups[c][a]].slope] if terms[groups[c][a]].slope else 1.0 for a in (one, two)]
            sums.append(np.bincount(codes[c], (1.0 if weight is None else weight) * x[0] * x[1] * np.ones(n), levels[c]))
        super().__init__(terms, levels, len(b), gram_matrices(groups, levels, sums), warm)

    def forward(self, part: dict, coefficients: np.ndarray) -> np.ndarray:
        fit = None
        for k, t in enumerate(self.terms):
            low, g = part["codes"][t.code]
            x = coefficients[self.edges[k] + low : self.edges[k + 1]][g]
            if t.slope:
                x *= part["slopes"][t.slope]
            fit = x if fit is None else np.add(fit, x, out=fit)
        if part["root"] is not None:
            fit *= part["root"]
        return fit

    def moved(self, i: int, z: np.ndarray, scale: float, old: float) -> float:
        """u := scale A z + old u; its length."""
        coefficients = (self.level_product(z, False) * scale).astype(self.kind)

        def one(part: dict) -> float:
            u = part["u"][i]
            u *= self.kind(old)
            u += self.forward(part, coefficients)
            return float(np.dot(u, u))

        return math.sqrt(sum(self.pool.map(one, self.parts)))

    def gathered(self, i: int) -> np.ndarray:
        """A'u."""

        def one(part: dict) -> list:
            u, out = part["u"][i], []
            if part["root"] is not None:
                u = u * part["root"]
            for t in self.terms:
                low, g = part["codes"][t.code]
                out.append((low, np.bincount(g, u * part["slopes"][t.slope] if t.slope else u)))
            return out

        total = np.zeros(self.edges[-1])
        for sums in self.pool.map(one, self.parts):
            for k, (low, s) in enumerate(sums):
                begin = self.edges[k] + low
                total[begin : begin + len(s)] += s
        return self.level_product(total, True)

    def start(self):
        every, zero = list(range(self.n_outcomes)), np.zeros(self.edges[-1])
        for part in self.parts:
            part["u"] = [x.copy() for x in part["b"]]
        self.x = [self.gathered(i) if self.warm else zero.copy() for i in every]
        self.beta = [self.moved(i, self.x[i], -1.0, 1.0) for i in every]  # u is kept unscaled, beta times what it stands for
        self.v = [self.gathered(i) / b if b else zero.copy() for i, b in zip(every, self.beta, strict=True)]
        self.alpha = [math.sqrt(float(v @ v)) for v in self.v]
        self.v = [v / a if a else v for v, a in zip(self.v, self.alpha, strict=True)]
        self.h, self.bar = [v.copy() for v in self.v], [zero.copy() for _ in every]
        return list(self.beta), list(self.alpha)

    def left(self, which, alpha):
        for i, a in zip(which, alpha, strict=True):
            self.beta[i] = self.moved(i, self.v[i], 1.0, -a / self.beta[i] if self.beta[i] else 0.0)
        return [self.beta[i] for i in which]

    def right(self, which, beta):
        for i, b in zip(which, beta, strict=True):
            new = self.v[i] * -b
            if b:
                new += self.gathered(i) / b
            self.alpha[i] = math.sqrt(float(new @ new))
            self.v[i] = new / self.alpha[i] if self.alpha[i] else new
        return [self.alpha[i] for i in which]


class Projection:
    """The rows of a block, sorted by the eliminated effect's code, less their fit by that effect alone."""

    def __init__(self, block: dict[str, np.ndarray], gone: Term, root: np.ndarray | None):
        code = block[gone.code]
        self.at = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        self.codes, self.count = code[self.at], np.diff(np.append(self.at, len(code)))
        self.column = np.ones(len(code)) if root is None else root
        if gone.slope:
            self.column = self.column * block[gone.slope]
        square = np.add.reduceat(self.column * self.column, self.at)
        self.inverse = np.divide(1, square, out=np.zeros_like(square), where=square > 0)

    def rest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What is left of rows, and the effect's coefficients by level. The second time takes the rounding of the first away."""
        total = np.zeros(len(self.at))
        for _ in range(2):
            one = np.add.reduceat(self.column * rows, self.at) * self.inverse
            rows = rows - self.column * np.repeat(one, self.count)
            total += one
        return rows, total

    def shared(self, code: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By another effect's code: the products of two columns that lie in the eliminated ones."""
        level = np.repeat(np.arange(len(self.at)), self.count)
        cells, where = np.unique(level * (int(code.max()) + 1) + code, return_inverse=True)
        sums = [np.bincount(where, self.column * x) for x in (one, two)]
        level, code = np.divmod(cells, int(code.max()) + 1)
        return code, sums[0] * sums[1] * self.inverse[level]


class PackedSpace(LevelSpace):
    """A packed design. weight: its column or None; outcomes: their columns, `summed` if they are already multiplied by the
    weight and added up. gone: an effect that is eliminated; the terms and levels are of the others."""

    def __init__(self, blocks: DataFrame, terms: list[Term], levels: dict[str, int], weight: str | None, outcomes: list[str], summed: bool, warm: bool, gone: Term | None = None):
        self.blocks, self.weight, self.outcomes, self.summed, self.gone = blocks, weight, outcomes, summed, gone
        every = [*terms, *([gone] if gone else [])]
        self.columns = [*levels, *([gone.code] if gone else []), *dict.fromkeys(t.slope for t in every if t.slope), *([weight] if weight else [])]
        groups = {c: [k for k, t in enumerate(terms) if t.code == c] for c in levels}
        pairs = gram_pairs(groups)

        def gram(block, _):
            root = np.sqrt(block[weight]) if weight else np.ones(len(block[terms[0].code]))
            w = block[weight] if weight else root
            away = Projection(block, gone, root) if gone else None
            for j, (c, a, b) in enumerate(pairs):
                x = [block[t.slope] if t.slope else 1.0 for t in (terms[groups[c][a]], terms[groups[c][b]])]
                yield j, block[c], w * x[0] * x[1]
                if gone:
                    yield len(pairs) + j, *away.shared(block[c], root * x[0], root * x[1])

        sums, _ = Pass(blocks, self.columns, [levels[c] for c, _, _ in pairs] * (2 if gone else 1), 0).run(gram)
        grams = gram_matrices(groups, levels, sums[: len(pairs)])
        if gone:
            for c, less in gram_matrices(groups, levels, sums[len(pairs) :]).items():
                whole = np.einsum("lpp->lp", grams[c])
                left = grams[c] - less
                own = np.einsum("lpp->lp", left) > CUTOFF * whole  # else the column lies in the eliminated ones
                grams[c] = left * own[:, :, None] * own[:, None, :]
        super().__init__(terms, levels, len(outcomes), grams, warm)

    def fits(self, names: list[str], rest: bool):
        """A function of a block and coefficients: per outcome the rows' fit, or what it leaves (rest), times their weights' roots."""
        terms, edges, weight, summed = self.terms, self.edges, self.weight, self.summed

        def run(block, held, root):
            for j, y in enumerate(names):
                fit = 0.0
                for k, t in enumerate(terms):
                    part = held[j, edges[k] : edges[k + 1]][block[t.code]]
                    fit = fit + (part * block[t.slope] if t.slope else part)
                if root is not None:
                    fit = fit * root
                if rest:
                    b = block[y]
                    if root is not None:
                        b = np.divide(b, root, out=np.zeros(len(b)), where=root > 0) if summed else b * root
                    fit = b - fit
                yield j, fit

        return lambda block, held: run(block, held, np.sqrt(block[weight]) if weight else None)

    def products(self, which, values, rest):
        terms, weight, gone, n = self.terms, self.weight, self.gone, len(self.terms)
        names = [self.outcomes[i] for i in which]
        coefficients, fits = np.array([self.level_product(z, False) for z in values]), self.fits(names, rest)

        def kernel(block, held):
            root = np.sqrt(block[weight]) if weight else None
            away = Projection(block, gone, root) if gone else None
            for j, fit in fits(block, held):
                if gone:
                    fit, _ = away.rest(fit)
                yield -1, j, float(fit @ fit)
                back = fit if root is None else fit * root
                for k, t in enumerate(terms):
                    yield j * n + k, block[t.code], back * block[t.slope] if t.slope else back

        columns = [*self.columns, *(names if rest else [])]
        sums, numbers = Pass(self.blocks, list(dict.fromkeys(columns)), self.sizes * len(which), len(which)).run(kernel, coefficients)
        out = [self.level_product(np.concatenate(sums[j * n : (j + 1) * n]), True) for j in range(len(which))]
        return out, numbers.tolist()

    def eliminated(self, code: str, columns: list[str]) -> DataFrame:
        """code and a column per outcome: the eliminated effect's coefficients, written by the tasks that hold the rows."""
        gone, weight, names = self.gone, self.weight, self.outcomes
        used, fits = list(dict.fromkeys([*self.columns, *names])), self.fits(names, True)
        sent = self.blocks.sparkSession.sparkContext.broadcast(np.array([self.level_product(x, False) for x in self.x]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in blocks_of(batches, used):
                away = Projection(block, gone, np.sqrt(block[weight]) if weight else None)
                found = [away.rest(fit)[1] for _, fit in fits(block, sent.value)]
                yield pa.RecordBatch.from_arrays([pa.array(away.codes.astype(np.int64)), *map(pa.array, found)], names=[code, *columns])

        with few_at_once(self.blocks.sparkSession):
            out = shared(self.blocks.select(*used).mapInArrow(run, ", ".join([f"{code} long", *[f"{c} double" for c in columns]])))
        sent.destroy()
        return out


def by_code(spark, name: str, columns: list[tuple[str, np.ndarray]]) -> DataFrame:
    """A table of a column of codes from 0 and columns by code."""
    n = len(columns[0][1])
    return spark.createDataFrame(pa.table({name: pa.array(np.arange(n, dtype=np.int64))} | {c: pa.array(x) for c, x in columns}))
