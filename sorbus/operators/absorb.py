"""Weighted least squares on high-cardinality group effects: residuals and coefficients.

Effects that all share one key have a closed form: per level a small Gram matrix, by one aggregation of the rows. Other
problems are solved by LSMR, whose steps are the same wherever its vectors live (see `strategy`). There rows of the same
keys and slopes are first added up to cells, which leaves the minimiser as it is, and effects that share a key are made
orthogonal within each level.

Inside, all columns have private names; an input column may have any name.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sorbus.operators.graph import Stored, connected_components, shared
from sorbus.plans.blocks import solved
from sorbus.plans.lsmr import Outcome, Rule, lsmr
from sorbus.plans.packed import BLOCK, CHUNK_BLOCKS, HELD, RESTARTS, UNSOLVED, CellSpace, LevelSpace, PackedSpace, Term, by_code, numbered, packed
from sorbus.plans.spaces import BROADCAST_BYTES, TableSpace, bytes_of, looked_up

LOCAL_BYTES = 32 << 20
LEVEL_BYTES = 256 << 20  # of the driver, for the levels' vectors of a packed design
VECTORS = 8 + HELD  # of which LSMR holds so many over the levels
ELIMINATED = 50_000  # levels of an effect from which a packed design eliminates it
BEYOND = 10  # times what was asked, from which a packed solve goes on
LEAST_SLOPE = 1e-13  # of the residual itself, which rounding lets no solve fall much below
QUIET_SECONDS = 2.0  # no progress is told of work that takes less
COMPONENT_ROWS = 1 << 20  # cells of the components that one task solves together; a larger component is solved apart
STRATEGIES = ("auto", "closed_form", "local", "packed", "components", "distributed")
log = logging.getLogger("sorbus")


def column(name: str) -> Column:
    """The column of that very name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


@dataclass(frozen=True, init=False)
class Effect:
    """A group effect: its key columns and, if it multiplies a continuous column, that slope."""

    keys: tuple[str, ...]
    slope: str | None

    def __init__(self, *keys: str, slope: str | None = None):
        if not keys:
            raise ValueError("an effect needs a key column")
        object.__setattr__(self, "keys", keys)
        object.__setattr__(self, "slope", slope)

    def __repr__(self) -> str:
        return "#".join(self.keys) + (f"*{self.slope}" if self.slope else "")

    def slope_type(self, df: DataFrame) -> T.DataType:
        """The type of the slope in df; an effect without one multiplies the integer 1."""
        return df.schema[self.slope].dataType if self.slope else T.IntegerType()


@dataclass
class Solved:
    """Coefficients of the effects of one key: keys named __k{j}, and __b{k}_{i} of effect k and outcome i.

    size: its bytes, if known. code: where the rows already hold codes of the key, the column by which they meet the table.
    """

    effects: list[int]
    keys: list[int]
    table: DataFrame
    size: int | None = None
    code: str | None = None


@dataclass
class Design:
    """What prepared() keeps: the rows with a code per key, the levels' tables, and the rows packed into blocks."""

    rows: DataFrame
    codes: list[str]
    levels: list[DataFrame]
    counts: list[int]
    blocks: Stored
    numbers: dict[str, str]
    gone: int | None


@dataclass(frozen=True)
class Options:
    nulls: str = "error"
    tol: float | None = None
    maxiter: int = 100_000
    local_bytes: int = LOCAL_BYTES
    strategy: str = "auto"
    double_precision: bool = True
    progress: bool = True
    damp: float = 0.0
    start: dict[str, list[DataFrame]] = field(default_factory=dict)
    level_bytes: int = LEVEL_BYTES

    @property
    def tolerance(self) -> float:
        return self.tol if self.tol is not None else float(np.finfo(np.float64 if self.double_precision else np.float32).eps ** 0.5)


class Absorber:
    """Reusable state: the checked table, its effects and the weight column.

    nulls: "error" rejects a null key, slope, weight or outcome (and NaN numbers), "drop" leaves such rows out.
    A zero weight gives a NaN residual; a group whose weighted squares of the slope sum to 0 has coefficient 0.
    An empty table gives an empty result. An output column replaces an input column of its name, but not a key.

    strategy: "closed_form" (effects of one key only), "local" (arrays of the driver), "packed" (rows in blocks of arrays,
    of which each round is one pass; the levels' vectors on the driver), "components" (those of few cells are solved in the
    tasks that hold them, several together; each stops by itself, and only larger ones go the next way) or "distributed"
    (every vector in a DataFrame). "auto" takes the closed form if it can; "local" while the rows have at most local_bytes, or
    a 64th of the driver's memory if that is less; "packed" while the levels' vectors have at most level_bytes, both measured
    first; else "components".
    double_precision: False solves in 32 bits ("local" and "distributed"). tol: by default the root of the precision's epsilon.
    damp: adds damp squared times the squares of the scaled coefficients (each column at length 1) to what is minimised.
    start: per outcome the tables of level_coefficients() from which its solve goes on; the outcome less their fit is solved.
    progress: steps are logged (logger "sorbus") once a solve has taken QUIET_SECONDS.
    """

    def __init__(self, df: DataFrame, effects: list[Effect], weight: str | None = None, nulls: str = "error", tol: float | None = None, maxiter: int = 100_000, **options):
        self.df, self.effects, self.weight, self.universe, self.design = df, list(effects), weight, None, None
        self.options = Options(nulls, tol, maxiter, **options)
        kinds = dict((f.name, f.dataType) for f in df.schema.fields)
        if not self.effects:
            raise ValueError("no effects")
        #: Effects by key: those whose Gram matrices are solved, or made orthogonal, together.
        self.groups: list[list[int]] = []
        where: dict = {}
        for k, e in enumerate(self.effects):
            group = where.setdefault(k if self.options.damp else frozenset(e.keys), [])
            if not group:
                self.groups.append(group)
            group.append(k)
        strategy = self.options.strategy
        if strategy not in STRATEGIES or (strategy == "closed_form" and len(self.groups) > 1):
            raise ValueError(f"strategy {strategy} for {len(self.effects)} effects on {len(self.groups)} keys")
        if self.options.damp < 0 or (self.options.damp and self.options.start):
            raise ValueError("damp must be 0 or more, and 0 where a solve goes on from coefficients")
        for c in [*self.keys, *self.numbers([])]:
            if c not in kinds:
                raise ValueError(f"no column {c}")
        for c in self.numbers([]):
            if not isinstance(kinds[c], T.NumericType):
                raise ValueError(f"column {c} is not numeric")
        self.tag = "__a"  # no column of the table begins with it
        while any(c.startswith(self.tag) for c in df.columns):
            self.tag += "_"
        self.stats: dict[str, Outcome] = {}

    def like(self, df: DataFrame, weight: str | None) -> Absorber:
        out = Absorber(df, self.effects, weight)
        out.options, out.groups, out.universe = self.options, self.groups, self.universe
        return out

    def prepared(self) -> Absorber:
        """The same with a design in the shared folder: levels numbered, rows with their codes, and blocks of all numeric
        columns by code. Solves under other weights and outcomes read the blocks; nothing is grouped by key columns again.
        """
        kinds = [f for f in self.df.schema.fields if isinstance(f.dataType, T.NumericType)]
        rows, levels, counts = self.checked([], weight=False), [], []
        for g in self.groups:
            keys = [column(c) for c in self.effects[g[0]].keys]
            held = numbered(rows.select(*[k.alias(f"__k{j}") for k, j in zip(keys, self.key_numbers(g), strict=True)]).distinct(), "__code")
            n, size = bytes_of(held)
            rows = self.matched(rows, held.withColumnRenamed("__code", f"{self.tag}c{len(levels)}"), self.key_numbers(g), size, "inner")
            levels.append(held)
            counts.append(n)
        held = Stored(rows)
        codes, numbers = [f"{self.tag}c{j}" for j in range(len(levels))], {f.name: f"n{i}" for i, f in enumerate(kinds)}
        gone = self.largest(counts)
        plain = held.df.select(*[F.col(c).alias(f"c{j}") for j, c in enumerate(codes)], *[column(f.name).cast("double").alias(numbers[f.name]) for f in kinds])
        out = self.like(self.df, self.weight)
        out.design = Design(held.df, codes, levels, counts, packed(plain, first([f"c{j}" for j in range(len(codes))], gone), list(numbers.values()), levels=sum(counts), whole=gone is not None), numbers, gone)
        return out

    def size(self) -> tuple[int, list[int]]:
        """Rows, and the levels of each effect; a subset has those of the whole table."""
        if self.design:
            return self.design.rows.count(), [self.design.counts[j] for k in range(len(self.effects)) for j, g in enumerate(self.groups) if k in g]
        of = self.df if self.universe is None else self.universe
        return self.df.count(), [of.select(*[column(c) for c in e.keys]).distinct().count() for e in self.effects]

    @property
    def keys(self) -> list[str]:
        return list(dict.fromkeys(k for e in self.effects for k in e.keys))

    def key_numbers(self, group: list[int]) -> list[int]:
        return [self.keys.index(c) for c in self.effects[group[0]].keys]

    def numbers(self, outcomes: list[str]) -> list[str]:
        return list(dict.fromkeys([e.slope for e in self.effects if e.slope] + ([self.weight] if self.weight else []) + outcomes))

    def with_weight(self, weight: str | None) -> Absorber:
        """The same table, effects and design under other weights."""
        out = self.like(self.df, weight)
        out.design = self.design
        return out

    def subset(self, rows: Column | str | range | list[int]) -> Absorber:
        """The rows for which a condition holds, or those at positions from 0, in the table's own order (a negative position
        counts from the end). The levels stay those of the whole table."""
        if isinstance(rows, (Column, str)):
            picked = self.df.where(rows)
        else:
            name = f"{self.tag}at"
            table = numbered(self.df, name)
            n = table.count()
            low, high = (min(rows), max(rows)) if len(rows) else (0, -1)
            if low < -n or high >= n:
                raise IndexError(f"positions {low} to {high} of {n} rows")
            if isinstance(rows, range) and low >= 0:
                at = F.col(name)
                inside = at.between(low, high) & (F.pmod(at - rows.start, F.lit(abs(rows.step))) == 0)
                picked = table.where(inside).drop(name)
            else:
                wanted = self.df.sparkSession.createDataFrame([(i % n,) for i in set(rows)], f"{name} long")
                picked = table.join(wanted, name, "left_semi").drop(name)
        out = self.like(picked, self.weight)
        out.universe = self.df if self.universe is None else self.universe
        return out

    def checked(self, outcomes: list[str], weight: bool = True, df: DataFrame | None = None) -> DataFrame:
        df, bad = self.df if df is None else df, F.lit(False)
        for c in self.keys:
            bad = bad | column(c).isNull()
        for c in self.numbers(outcomes):
            if weight or c != self.weight:
                bad = bad | column(c).isNull() | F.isnan(column(c).cast("double"))
        if self.options.nulls == "drop":
            df = df.where(~bad)
        else:
            df = df.where(F.when(bad, F.raise_error(F.lit("null or NaN in a key, slope, weight or outcome")).cast("boolean")).otherwise(True))
        if self.weight and weight:
            ok = F.when(column(self.weight) < 0, F.raise_error(F.lit("negative weight")).cast("boolean")).otherwise(True)
            df = df.where(ok)
        return df

    def x(self, e: Effect) -> Column:
        return column(e.slope).cast("double") if e.slope else F.lit(1.0)

    def w(self) -> Column:
        return column(self.weight).cast("double") if self.weight else F.lit(1.0)

    def slope_name(self, e: Effect) -> str | None:
        return f"__x{list(dict.fromkeys(f.slope for f in self.effects if f.slope)).index(e.slope)}" if e.slope else None

    def plain(self, outcomes: list[str]) -> DataFrame:
        """The checked rows under private names: __k{j}, __x{j}, __w and __y{i}, less the fit that a solve starts from."""
        rows, less = self.checked(outcomes), {}
        for i, y in enumerate(outcomes):
            for k, t in enumerate(self.options.start.get(y, [])):
                name, e = f"{self.tag}s{k}_{i}", self.effects[k]
                table = t.select(*[column(c).alias(f"__k{self.keys.index(c)}") for c in e.keys], column("coef").alias(name))
                rows = self.matched(rows, table, [self.keys.index(c) for c in e.keys], bytes_of(table)[1])
                less[i] = less.get(i, F.lit(0.0)) + self.x(e) * F.coalesce(F.col(name), F.lit(0.0))
        slopes = {self.slope_name(e): self.x(e) for e in self.effects if e.slope}
        numbers = [self.w().alias("__w"), *[(column(y).cast("double") - less.get(i, F.lit(0.0))).alias(f"__y{i}") for i, y in enumerate(outcomes)]]
        return rows.select(*[column(c).alias(f"__k{j}") for j, c in enumerate(self.keys)], *[x.alias(c) for c, x in slopes.items()], *numbers)

    def inner_x(self, k: int) -> Column:
        e = self.effects[k]
        return F.col(self.slope_name(e)) if e.slope else F.lit(1.0)

    def matched(self, df: DataFrame, table: DataFrame, keys: list[int], size: int | None, how: str = "left") -> DataFrame:
        """df with the columns of table (keys named __k{j}) by its own key columns; if its size is known, and small, the
        table goes to all executors, else Spark chooses."""
        own = {f"__k{j}": f"{self.tag}k{j}" for j in keys}
        table = table.withColumnsRenamed(own)
        on = [column(self.keys[j]) == F.col(f"{self.tag}k{j}") for j in keys]
        if size is not None and size <= BROADCAST_BYTES:
            table = F.broadcast(table)
        return df.join(table, on, how).drop(*own.values())

    def scales(self, k: int) -> DataFrame:
        """Per level of effect k: 1 over the root of the weighted squares of its slope, or 0 where these sum to 0."""
        e = self.effects[k]
        keys = [self.keys.index(c) for c in e.keys]
        ss = self.plain([]).groupBy(*[f"__k{j}" for j in keys]).agg(F.sum(F.col("__w") * self.inner_x(k) * self.inner_x(k)).alias("__ss"))
        scale = F.when(F.col("__ss") > 0, 1 / F.sqrt(F.when(F.col("__ss") > 0, F.col("__ss")))).otherwise(0.0)
        return ss.select(*[F.col(f"__k{j}").alias(c) for j, c in zip(keys, e.keys, strict=True)], scale.alias(self.free("scale", e)))

    def free(self, name: str, e: Effect) -> str:
        if name in e.keys:
            raise ValueError(f"the column {name} of the result is named like a key")
        return name

    def cells(self, outcomes: list[str]) -> DataFrame:
        slopes = dict.fromkeys(self.slope_name(e) for e in self.effects if e.slope)
        by = [*[f"__k{j}" for j in range(len(self.keys))], *slopes]
        sums = [F.sum("__w").alias("__w"), *[F.sum(F.col("__w") * F.col(f"__y{i}")).alias(f"__wy{i}") for i in range(len(outcomes))]]
        return self.plain(outcomes).groupBy(*by).agg(*sums)

    def raw_coefficients(self, outcomes: list[str], warm: bool) -> list[Solved]:
        o = self.options
        if self.design and o.strategy in ("auto", "packed", "closed_form") and not o.start and (found := self.from_design(outcomes, warm)):
            return found
        if len(self.groups) == 1 and o.strategy in ("auto", "closed_form"):
            self.stats = {y: Outcome(1, True, 0) for y in outcomes}
            return [self.closed_form(outcomes)]
        local = o.strategy == "local"
        if o.strategy == "auto":
            rows = self.plain(outcomes)
            most = min(o.local_bytes, rows.sparkSession._jvm.java.lang.Runtime.getRuntime().maxMemory() // 64)
            local = bytes_of(rows)[1] <= most
        if local:
            return self.local(shared(self.cells(outcomes)), outcomes, warm)
        if o.strategy == "components":
            return self.by_component(shared(self.cells(outcomes)), outcomes, warm)
        if o.strategy == "packed" or (o.strategy == "auto" and o.double_precision):
            levels = [numbered(self.plain([]).select(*[f"__k{j}" for j in self.key_numbers(g)]).distinct(), "__code") for g in self.groups]
            sizes = [bytes_of(t) for t in levels]
            gone = self.largest([n for n, _ in sizes]) if self.unique(warm) else None
            total = sum(n * len(g) for j, ((n, _), g) in enumerate(zip(sizes, self.groups, strict=True)) if j != gone)
            if o.strategy == "packed" or 8 * VECTORS * len(outcomes) * total <= o.level_bytes:
                return self.pack(levels, sizes, outcomes, warm, gone)
            return self.by_component(shared(self.cells(outcomes)), outcomes, warm)
        return self.distributed(shared(self.cells(outcomes)), outcomes, warm)

    def unique(self, residuals: bool) -> bool:
        """Is what is asked for unique? Residuals are, and the normalised coefficients of two effects without slopes; of
        others the shortest are wanted, of all effects together, and none may be eliminated."""
        return residuals or (len(self.effects) == len(self.groups) == 2 and not any(e.slope for e in self.effects))

    def largest(self, counts: list[int]) -> int | None:
        """The key that a packed design eliminates: that of the most levels, from ELIMINATED on, if it has one effect and no
        level of more rows than are sorted together. None if damped: then the effect's own coefficients are damped too."""
        j = int(np.argmax(counts))
        if len(counts) < 2 or counts[j] < ELIMINATED or len(self.groups[j]) > 1 or self.options.damp:
            return None
        rows = self.df.groupBy(*[column(c) for c in self.effects[self.groups[j][0]].keys]).agg(F.count("*").alias("__n"))
        return j if rows.agg(F.max("__n")).first()[0] <= CHUNK_BLOCKS * BLOCK else None

    def closed_form(self, outcomes: list[str]) -> Solved:
        """One aggregation by the key all effects share; nothing is written. Slopes are taken from their mean first, if
        there is an intercept, so that one that lies far from 0 costs no digits."""
        group, m, keys = self.groups[0], len(outcomes), self.key_numbers(self.groups[0])
        rows, by = self.plain(outcomes), [f"__k{j}" for j in keys]
        if len(group) == 1:
            (k,) = group
            x = self.inner_x(k)
            more = 1 + self.options.damp**2
            sums = [F.sum(F.col("__w") * x * F.col(f"__y{i}")).alias(f"__s{i}") for i in range(m)]
            one = rows.groupBy(*by).agg(F.sum(F.col("__w") * x * x).alias("__ss"), *sums)
            value = [F.when(F.col("__ss") > 0, F.try_divide(F.col(f"__s{i}"), F.col("__ss") * more)).otherwise(0.0).alias(f"__b{k}_{i}") for i in range(m)]
            return Solved(group, keys, one.select(*by, *value))
        unit = next((a for a, k in enumerate(group) if not self.effects[k].slope), None)
        p, shift = len(group), np.zeros(len(group))
        if unit is not None:
            slopes = [a for a, k in enumerate(group) if self.effects[k].slope]
            means = rows.agg(*[F.avg(self.inner_x(group[a])) for a in slopes]).first() if slopes else []
            shift[slopes] = [x or 0.0 for x in means]
        x = [self.inner_x(k) - F.lit(float(shift[a])) for a, k in enumerate(group)]
        pairs = [(a, b) for a in range(p) for b in range(a + 1)]
        gram = [F.sum(F.col("__w") * x[a] * x[b]) for a, b in pairs]
        right = [F.sum(F.col("__w") * x[a] * F.col(f"__y{i}")) for a in range(p) for i in range(m)]
        sums = rows.groupBy(*by).agg(F.array(*gram).alias("__gram"), F.array(*right).alias("__right"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.num_rows
                flat = batch.column("__gram").flatten().to_numpy(zero_copy_only=False).reshape(n, len(pairs))
                r = batch.column("__right").flatten().to_numpy(zero_copy_only=False).reshape(n, p, m)
                g = np.empty((n, p, p))
                for j, (a, b) in enumerate(pairs):
                    g[:, a, b] = g[:, b, a] = flat[:, j]
                out = solved(g, r, unit, shift if unit is not None else None) if n else r
                found = pa.FixedSizeListArray.from_arrays(pa.array(out.reshape(-1)), p * m).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], found], names=[*by, "__b"])

        schema = T.StructType([*[sums.schema[c] for c in by], T.StructField("__b", T.ArrayType(T.DoubleType()))])
        table = sums.mapInArrow(run, schema)
        value = [F.col("__b")[a * m + i].alias(f"__b{k}_{i}") for a, k in enumerate(group) for i in range(m)]
        return Solved(group, keys, table.select(*by, *value))

    def solve(self, space: LevelSpace | TableSpace, outcomes: list[str], warm: bool) -> None:
        began = time.monotonic()

        def tell(step: int, left: int) -> None:
            if self.options.progress and time.monotonic() - began > QUIET_SECONDS:
                log.info("step %d, %d of %d outcomes left", step, left, len(outcomes))

        tol = self.options.tolerance
        most = max(1, self.options.maxiter - warm)
        found = lsmr(space, Rule(tol, tol, maxiter=most), self.options.damp, tell=tell)
        enough = BEYOND * max(tol, LEAST_SLOPE)
        for n in range(RESTARTS + 1 if isinstance(space, PackedSpace) and not self.options.damp else 0):
            left = most - max((o.iterations for o in found), default=0)
            if not (open_ := space.restarted(enough)) or left <= 0 or n == RESTARTS:
                break
            steps = max(1, max(o.iterations for o in found) // 2 ** (n + 1))  # fewer, if rounding has spoilt what so many made
            more = lsmr(space, Rule(tol, tol, maxiter=min(left, steps) if space.worse else left), tell=tell)
            found = [Outcome(o.iterations + m.iterations, m.converged, m.istop) if i in open_ else o for i, (o, m) in enumerate(zip(found, more, strict=True))]
        if isinstance(space, PackedSpace) and not self.options.damp:
            found = [Outcome(o.iterations, slope <= enough or (o.converged and slope <= max(tol, UNSOLVED)), o.istop) for o, slope in zip(found, space.slopes, strict=True)]
        self.stats = {y: Outcome(o.iterations + warm, o.converged, o.istop) for y, o in zip(outcomes, found, strict=True)}

    def warmed(self, warm: bool) -> bool:
        return warm and not self.options.damp and not self.options.start

    def terms(self, slope: dict[str | None, str | None]) -> list[Term]:
        return [Term(f"c{j}", slope[self.effects[k].slope], a) for k in range(len(self.effects)) for j, g in enumerate(self.groups) for a, i in enumerate(g) if i == k]

    def by_level(self, space: LevelSpace, gone: int | None = None) -> list[list[tuple[str, np.ndarray]]]:
        """Per key the columns __b{k}_{i} by code; none of an eliminated one."""
        found = space.coefficients()
        place = {k: n for n, k in enumerate(k for k in range(len(self.effects)) if gone is None or k not in self.groups[gone])}
        return [[(f"__b{k}_{i}", b[place[k]]) for k in g if k in place for i, b in enumerate(found)] for g in self.groups]

    def packed_space(self, blocks: DataFrame, slopes: dict, counts: list[int], weight: str | None, ys: list[str], summed: bool, warm: bool, gone: int | None) -> PackedSpace:
        terms, away = self.terms(slopes), f"c{gone}"
        levels = {f"c{j}": n for j, n in enumerate(counts) if j != gone}
        return PackedSpace(blocks, [t for t in terms if t.code != away], levels, weight, ys, summed, warm, next((t for t in terms if t.code == away), None))

    def pack(self, levels: list[DataFrame], sizes: list[tuple[int, int]], outcomes: list[str], warm: bool, gone: int | None = None) -> list[Solved]:
        coded = self.plain(outcomes)
        for j, (g, t, (_, size)) in enumerate(zip(self.groups, levels, sizes, strict=True)):
            coded = looked_up(coded, t.withColumnRenamed("__code", f"c{j}"), [f"__k{i}" for i in self.key_numbers(g)], size=size)
        slopes = {e.slope: "n" + self.slope_name(e)[3:] for e in self.effects if e.slope}
        wy = [f"nwy{i}" for i in range(len(outcomes))]
        numbers = [*[F.col(f"__x{c[1:]}").alias(c) for c in slopes.values()], F.col("__w").alias("nw"), *[(F.col("__w") * F.col(f"__y{i}")).alias(c) for i, c in enumerate(wy)]]
        codes, counts = first([f"c{j}" for j in range(len(levels))], gone), [n for n, _ in sizes]
        blocks = packed(coded.select(*codes, *numbers), codes, [*slopes.values(), "nw", *wy], ("nw", *wy), sum(counts), gone is not None)
        space = self.packed_space(blocks.df, {None: None} | slopes, counts, "nw", wy, True, self.warmed(warm), gone)
        self.solve(space, outcomes, self.warmed(warm))
        out = []
        for j, (g, t, (n, size), b) in enumerate(zip(self.groups, levels, sizes, self.by_level(space, gone), strict=True)):
            small = self.absent(space, g, "__code", len(outcomes)) if j == gone else by_code(t.sparkSession, "__code", b)
            bytes_ = 8 * n * (1 + len(g) * len(outcomes))
            table = t.join(F.broadcast(small) if bytes_ <= BROADCAST_BYTES else small, "__code").drop("__code")
            out.append(Solved(g, self.key_numbers(g), table, size + bytes_))
        blocks.drop()
        return out

    def absent(self, space: PackedSpace, group: list[int], code: str, outcomes: int) -> DataFrame:
        """The coefficients of the eliminated key's effect by code."""
        return space.eliminated(code, [f"__b{group[0]}_{i}" for i in range(outcomes)])

    def from_design(self, outcomes: list[str], warm: bool) -> list[Solved]:
        """Solves on the blocks; none, if rows must be left out for what their weights or outcomes hold."""
        d = self.design
        weight, ys = d.numbers.get(self.weight) if self.weight else None, [d.numbers.get(y) for y in outcomes]
        if None in ys or (self.weight and not weight):
            raise ValueError("a weight or an outcome is not a numeric column")
        if d.gone is not None and not self.unique(warm):
            return []
        total = sum(n * len(g) for j, (n, g) in enumerate(zip(d.counts, self.groups, strict=True)) if j != d.gone)
        if self.options.strategy == "auto" and 8 * VECTORS * len(outcomes) * total > self.options.level_bytes:
            return []
        bad = [F.isnan(column(c).cast("double")) | column(c).isNull() for c in [*outcomes, *([self.weight] if self.weight else [])]]
        wrong = d.rows.agg(F.count_if(any_of(bad)), F.count_if(self.w() < 0)).first()
        if wrong[1]:
            raise ValueError("negative weight")
        if wrong[0]:
            if self.options.nulls == "error":
                raise ValueError("null or NaN in a key, slope, weight or outcome")
            return []
        slopes = {None: None} | {e.slope: d.numbers[e.slope] for e in self.effects if e.slope}
        one = len(self.groups) == 1 and not self.options.damp
        space = self.packed_space(d.blocks.df, slopes, d.counts, weight, ys, False, self.warmed(warm) and not one, d.gone)
        if one:  # all columns are at right angles, so A'b is the solution
            every = list(range(len(ys)))
            space.x = space.products(every, [np.zeros(space.edges[-1])] * len(ys), True)[0]
            self.stats = {y: Outcome(1, True, 0) for y in outcomes}
        else:
            self.solve(space, outcomes, self.warmed(warm))
        out = []
        for j, (g, n, b) in enumerate(zip(self.groups, d.counts, self.by_level(space, d.gone), strict=True)):
            table = self.absent(space, g, d.codes[j], len(ys)) if j == d.gone else by_code(d.rows.sparkSession, d.codes[j], b)
            out.append(Solved(g, self.key_numbers(g), table, 8 * n * (1 + len(g) * len(ys)), d.codes[j]))
        return out

    def local(self, cells: DataFrame, outcomes: list[str], warm: bool) -> list[Solved]:
        spark, pdf = cells.sparkSession, cells.toArrow().to_pandas()
        names = [[f"__k{j}" for j in self.key_numbers(g)] for g in self.groups]
        first, _ = codes_of(pdf, names[0])
        pdf = pdf.iloc[np.argsort(first, kind="stable")].reset_index(drop=True)
        w, codes, levels = pdf["__w"].to_numpy(float), {}, {}
        for j, by in enumerate(names):
            codes[f"c{j}"], levels[f"c{j}"] = codes_of(pdf, by)
        names_of = {e.slope: self.slope_name(e) for e in self.effects if e.slope}
        slopes = {c: pdf[c].to_numpy(float) for c in names_of.values()}
        root = np.sqrt(w)
        b = [np.divide(pdf[f"__wy{i}"].to_numpy(float), root, out=np.zeros(len(w)), where=root > 0) for i in range(len(outcomes))]
        warm = self.warmed(warm)
        space = CellSpace(self.terms({None: None} | names_of), levels, codes, slopes, None if (w == 1).all() else w, b, warm, np.float64 if self.options.double_precision else np.float32)
        self.solve(space, outcomes, warm)
        out, kinds = [], {f.name: f for f in cells.schema.fields}
        for j, (group, by, columns) in enumerate(zip(self.groups, names, self.by_level(space), strict=True)):
            g, n = codes[f"c{j}"], levels[f"c{j}"]
            at = np.zeros(n, np.int64)
            at[g[::-1]] = np.arange(len(g))[::-1]
            table = pdf[by].iloc[at].reset_index(drop=True).assign(**dict(columns))
            schema = T.StructType([kinds[c] for c in by] + [T.StructField(c, T.DoubleType()) for c, _ in columns])
            texts = sum(int(table[c].str.len().sum()) * 4 for c in by if isinstance(kinds[c].dataType, T.StringType))
            out.append(Solved(group, self.key_numbers(group), spark.createDataFrame(table, schema), texts + 8 * n * len(table.columns)))
        return out

    def by_component(self, cells: DataFrame, outcomes: list[str], warm: bool) -> list[Solved]:
        """Levels that share no cell, however far they are followed, share no equation: components are dealt into buckets of
        some COMPONENT_ROWS cells, and a task solves a bucket's. What a larger component has is solved in DataFrames."""
        sets = [[f"__k{j}" for j in self.key_numbers(g)] for g in self.groups]
        comps = linked_levels(cells, sets)
        by = shared(looked_up(cells, comps[0], sets[0]))
        sizes = by.groupBy("__component").agg(F.count("*").alias("__n"))
        large = shared(sizes.where(F.col("__n") > COMPONENT_ROWS).select("__component"))  # cells / COMPONENT_ROWS rows at most
        found: list[Solved] = []
        if large.count():
            found = self.distributed(shared(by.join(F.broadcast(large), "__component", "left_semi").drop("__component")), outcomes, warm)
            by = shared(by.join(F.broadcast(large), "__component", "left_anti"))
        beyond = dict(self.stats)
        n = max(1, by.count() // (COMPONENT_ROWS // 2), min(by.sparkSession.sparkContext.defaultParallelism, by.count() // 4096))
        coded = by.withColumn("__bucket", F.pmod(F.xxhash64("__component"), F.lit(n)).cast("int"))
        levels = []
        for j, keys in enumerate(sets):
            t = numbered(by.select(*keys).distinct(), "__code")
            levels.append(t)
            coded = looked_up(coded, t.withColumnRenamed("__code", f"c{j}"), keys)
        slopes = {e.slope: self.slope_name(e) for e in self.effects if e.slope}
        codes, wy, m = [f"c{j}" for j in range(len(sets))], [f"__wy{i}" for i in range(len(outcomes))], len(outcomes)
        terms, warm, tol = self.terms({None: None} | slopes), self.warmed(warm), self.options.tolerance
        rule, damp, groups = Rule(tol, tol, maxiter=max(1, self.options.maxiter - warm)), self.options.damp, self.groups
        kind = np.float64 if self.options.double_precision else np.float32

        def run(table: pa.Table) -> pa.Table:
            column_of = {c: table.column(c).to_numpy() for c in [*codes, *slopes.values(), "__w", *wy]}
            order = np.argsort(column_of["c0"], kind="stable")
            column_of = {c: x[order] for c, x in column_of.items()}
            own = {c: np.unique(column_of[c], return_inverse=True) for c in codes}
            w = column_of["__w"]
            b = [np.divide(column_of[c], np.sqrt(w), out=np.zeros(len(w)), where=w > 0) for c in wy]
            space = CellSpace(terms, {c: len(u) for c, (u, _) in own.items()}, {c: at for c, (_, at) in own.items()}, {s: column_of[s] for s in slopes.values()}, w, b, warm, kind, 1)
            ends = lsmr(space, rule, damp)
            rows = [(-1, i, [float(e.iterations + warm), float(e.converged), float(e.istop)]) for i, e in enumerate(ends)]
            beta = space.coefficients()
            for j, g in enumerate(groups):
                values = np.stack([beta[i][k] for k in g for i in range(m)], 1)
                rows += [(j, int(c), v) for c, v in zip(own[codes[j]][0], values.tolist(), strict=True)]
            return pa.table([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.float64())), strict=True)], names=["set", "code", "b"])

        solved_here = shared(coded.groupBy("__bucket").applyInArrow(run, "set int, code long, b array<double>"))
        told = solved_here.where("set = -1").groupBy("code").agg(F.max(F.col("b")[0]), F.min(F.col("b")[1]), F.max(F.col("b")[2])).collect()
        here = {outcomes[r.code]: Outcome(int(r[1]), bool(r[2]), int(r[3])) for r in told}
        self.stats = {y: max([o for o in (beyond.get(y) if found else None, here.get(y)) if o] or [Outcome(0, True, 0)], key=lambda o: (not o.converged, o.iterations)) for y in outcomes}
        out = []
        for j, (g, t) in enumerate(zip(self.groups, levels, strict=True)):
            b = solved_here.where(F.col("set") == j).select(F.col("code").alias("__code"), *[F.col("b")[a * m + i].alias(f"__b{k}_{i}") for a, k in enumerate(g) for i in range(m)])
            table = t.join(b, "__code").drop("__code")
            if found:
                table = table.unionByName(found[j].table)
            out.append(Solved(g, self.key_numbers(g), shared(table)))
        return out

    def row_space(self, outcomes: list[str]) -> TableSpace:
        """The problem's vectors over the rows as they are, not over cells; for its products apart from a solve."""
        rows = self.plain(outcomes)
        return self.table_space(rows.withColumns({f"__wy{i}": F.col("__w") * F.col(f"__y{i}") for i in range(len(outcomes))}), outcomes, False)

    def own_keys(self, e: Effect) -> list[Column]:
        return [F.col(f"__k{self.keys.index(c)}").alias(c) for c in e.keys]

    def gathered(self, outcomes: list[str]) -> list[DataFrame]:
        """Per effect its keys and g0, g1, ...: the scaled design's transpose times each weighted outcome."""
        space = self.row_space(outcomes)
        space.transposed(list(range(len(outcomes))), [0.0] * len(outcomes), "__g")
        out = [shared(t.select(*self.own_keys(e), *[F.col(f"__g{i}").alias(self.free(f"g{i}", e)) for i in range(len(outcomes))])) for e, t in zip(self.effects, space.levels, strict=True)]
        space.drop()
        return out

    def scattered(self, value: Column) -> DataFrame:
        """The rows' keys and `scattered`: the scaled design times a level column that may use the level's keys."""
        space = self.row_space([])
        space.m, space.u_scale = 1, [1.0]
        space.rows = space.rows.withColumn("__u0", F.lit(0.0))
        named = [t.withColumns({c: k for c, k in zip(e.keys, [F.col(f"__k{self.keys.index(c)}") for c in e.keys], strict=True)}) for e, t in zip(self.effects, space.levels, strict=True)]
        space.levels = [t.withColumn("__o0", value.cast("double")).drop(*e.keys) for e, t in zip(self.effects, named, strict=True)]
        space.product([0], "__o", [1.0], [0.0])
        out = shared(space.rows.select(*[F.col(f"__k{j}").alias(c) for j, c in enumerate(self.keys)], F.col("__u0").alias("scattered")))
        space.drop()
        return out

    def table_space(self, cells: DataFrame, outcomes: list[str], warm: bool) -> TableSpace:
        groups = [([f"__k{j}" for j in self.key_numbers(g)], {k: self.inner_x(k) for k in g}) for g in self.groups]
        b = [F.when(F.col("__w") > 0, F.try_divide(F.col(f"__wy{i}"), F.sqrt("__w"))) for i in range(len(outcomes))]
        return TableSpace(cells, groups, "__w", b, warm, "double" if self.options.double_precision else "float")

    def distributed(self, cells: DataFrame, outcomes: list[str], warm: bool) -> list[Solved]:
        warm = self.warmed(warm)
        space = self.table_space(cells, outcomes, warm)
        self.solve(space, outcomes, warm)
        return [Solved(g, self.key_numbers(g), t, size) for g, (t, size) in zip(self.groups, space.end(), strict=True)]

    def rows_with(self, found: list[Solved], outcomes: list[str]) -> DataFrame:
        """The checked rows with every level's columns looked up, __b{k}_{i} under private names."""
        coded = all(s.code for s in found)
        df = self.checked(outcomes, df=self.design.rows if coded else None)
        for s in found:
            table = s.table.withColumnsRenamed({f"__b{k}_{i}": f"{self.tag}b{k}_{i}" for k in s.effects for i in range(len(outcomes))})
            if coded:
                df = df.join(F.broadcast(table) if s.size <= BROADCAST_BYTES else table, s.code, "left")
            else:
                df = self.matched(df, table, s.keys, s.size)
        return df

    def finished(self, df: DataFrame, new: dict[str, Column]) -> DataFrame:
        """The table's columns, without those that `new` replaces, and the new ones."""
        if taken := sorted(set(new) & set(self.keys)):
            raise ValueError(f"the columns {', '.join(taken)} of the result are named like keys")
        return df.select(*[column(c) for c in self.df.columns if c not in new], *[x.alias(c) for c, x in new.items()])

    def residuals(self, outcomes: list[str], suffix: str = "_res") -> DataFrame:
        """The table with a residual column per outcome."""
        outcomes = list(outcomes)
        df, new = self.rows_with(self.raw_coefficients(outcomes, warm=True), outcomes), {}
        for i, y in enumerate(outcomes):
            fit = F.lit(0.0)
            for k, e in enumerate(self.effects):
                fit = fit + self.x(e) * F.coalesce(F.col(f"{self.tag}b{k}_{i}"), F.lit(0.0))
            for k, t in enumerate(self.options.start.get(y, [])):
                name, e = f"{self.tag}s{k}_{i}", self.effects[k]
                table = t.select(*[column(c).alias(f"__k{self.keys.index(c)}") for c in e.keys], column("coef").alias(name))
                df = self.matched(df, table, [self.keys.index(c) for c in e.keys], bytes_of(table)[1])
                fit = fit + self.x(e) * F.coalesce(F.col(name), F.lit(0.0))
            res = column(y).cast("double") - fit
            new[y + suffix] = F.when(self.w() == 0, F.lit(float("nan"))).otherwise(res) if self.weight else res
        return self.finished(df, new)

    def inner_coefficients(self, y: str) -> list[DataFrame]:
        """Per effect (__k{j}, __coef), normalised within the components that the effects without slope connect."""
        tables: list = [None] * len(self.effects)
        for s in self.raw_coefficients([y], warm=False):
            t = s.table
            if s.code:
                t = self.design.levels[self.groups.index(s.effects)].withColumnRenamed("__code", s.code).join(t, s.code)
            for k in s.effects:
                tables[k] = t.select(*[f"__k{j}" for j in s.keys], F.col(f"__b{k}_0").alias("__coef"))
        for k, t in enumerate(self.options.start.get(y, [])):
            keys = [f"__k{self.keys.index(c)}" for c in self.effects[k].keys]
            begun = t.select(*[column(c).alias(n) for c, n in zip(self.effects[k].keys, keys, strict=True)], column("coef").alias("__begun"))
            tables[k] = tables[k].join(begun, keys, "left").select(*keys, (F.col("__coef") + F.coalesce("__begun", F.lit(0.0))).alias("__coef"))
        plain = [k for k, e in enumerate(self.effects) if not e.slope]
        if len(plain) > 1:
            sets = [[f"__k{self.keys.index(c)}" for c in self.effects[k].keys] for k in plain]
            comps = linked_levels(self.plain([y]), sets)
            shift = None
            for j, (k, keys) in enumerate(zip(plain, sets, strict=True)):
                tables[k] = tables[k].join(comps[j], keys)
                if j:
                    mean = shared(tables[k].groupBy("__component").agg(F.avg("__coef").alias(f"__m{j}")))
                    tables[k] = tables[k].join(mean, "__component").select(*keys, (F.col("__coef") - F.col(f"__m{j}")).alias("__coef"))
                    shift = mean if shift is None else shift.join(mean, "__component")
            total = shift.select("__component", sum((F.col(f"__m{j}") for j in range(2, len(plain))), F.col("__m1")).alias("__m"))
            tables[plain[0]] = tables[plain[0]].join(total, "__component").select(*sets[0], (F.col("__coef") + F.col("__m")).alias("__coef"))
        return tables

    def level_coefficients(self, y: str, levels: list[DataFrame | None] | None = None, name: str = "coef") -> list[DataFrame]:
        """Per effect its keys and `name`, normalised within the components that the effects without slope connect.

        Given `levels` (tables of keys, or None), and in a subset, groups not in the table are kept with coefficient 0.
        """
        out = []
        for k, (e, t) in enumerate(zip(self.effects, self.inner_coefficients(y), strict=True)):
            t = t.select(*self.own_keys(e), F.col("__coef").alias(self.free(name, e)))
            every = levels[k] if levels else self.universe
            if every is not None:
                keys = every.select(*[column(c) for c in e.keys]).distinct()
                t = keys.join(t, list(e.keys), "left").select(*[column(c) for c in e.keys], F.coalesce(column(name), F.lit(0.0)).alias(name))
            out.append(t)
        return out

    def coefficients(self, y: str, prefix: str = "coef") -> DataFrame:
        """The table with one column per effect: the coefficient of the row's level."""
        df, new = None, {}
        for k, (e, t) in enumerate(zip(self.effects, self.inner_coefficients(y), strict=True)):
            name = f"{self.tag}b{k}"
            df = self.checked([y]) if df is None else df
            df = self.matched(df, t.withColumnRenamed("__coef", name), [self.keys.index(c) for c in e.keys], None)
            new[f"{prefix}{k + 1}"] = F.col(name)
        return self.finished(df, new)

    def statistics(self) -> DataFrame:
        rows = [(y, o.iterations, o.converged, o.istop) for y, o in self.stats.items()]
        return self.df.sparkSession.createDataFrame(rows, "outcome string, iterations int, converged boolean, istop int")


def first(names: list[str], at: int | None) -> list[str]:
    """names, that at `at` before the others."""
    return names if at is None else [names[at], *[c for j, c in enumerate(names) if j != at]]


def any_of(terms: list[Column]) -> Column:
    out = F.lit(False)
    for t in terms:
        out = out | t
    return out


def codes_of(pdf: pd.DataFrame, keys: list[str]) -> tuple[np.ndarray, int]:
    """Codes from 0 in the order of the keys, in which rows of near levels often lie near each other."""
    if len(pdf) == 0:
        return np.zeros(0, np.int64), 0
    if len(keys) == 1:
        codes, levels = pd.factorize(pdf[keys[0]], sort=True, use_na_sentinel=False)
        return codes.astype(np.int64), len(levels)
    g = pdf.groupby(keys, sort=True, dropna=False, observed=True)
    return g.ngroup().to_numpy(np.int64), g.ngroups


def encode(df: DataFrame, effect: Effect, name: str = "code") -> DataFrame:
    """Dense codes from 1 per distinct key tuple, in key order: the keys and `name`.

    The order within range partitions is numbered apart; only one count per partition meets in the last step.
    """
    if name in effect.keys:
        raise ValueError(f"the column {name} of the result is named like a key")
    keys = [f"__k{j}" for j in range(len(effect.keys))]
    plain = df.select(*[column(c).alias(k) for c, k in zip(effect.keys, keys, strict=True)])
    levels = shared(plain.distinct().orderBy(*keys).withColumn("__p", F.spark_partition_id()))
    counts = levels.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__at"))
    local = levels.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*keys)))
    named = [F.col(k).alias(c) for c, k in zip(effect.keys, keys, strict=True)]
    return local.join(F.broadcast(before), "__p").select(*named, (F.col("__at") + F.col("__i")).cast("long").alias(name))


def linked_levels(df: DataFrame, sets: list[list[str]]) -> list[DataFrame]:
    """Per set of key columns (keys, __component): levels of all sets are linked when they share a row; a component is a
    number. Levels are told by their key columns, as groupBy tells them, and numbered; what iterates are pairs of numbers.
    """
    every = list(dict.fromkeys(c for keys in sets for c in keys))
    pairs, levels = shared(df.select(*every).distinct()), []
    linked = pairs
    for k, keys in enumerate(sets):
        # The numbers are written before they are used, so they stay as they are.
        t = shared(pairs.select(*keys).distinct().withColumn("__node", F.monotonically_increasing_id() * len(sets) + k))
        levels.append(t)
        linked = looked_up(linked, t.withColumnRenamed("__node", f"__n{k}"), keys)
    linked = shared(linked.select(*[f"__n{k}" for k in range(len(sets))]))
    edges = None
    for k in range(1, len(sets)):
        pair = linked.select(F.col("__n0").alias("src"), F.col(f"__n{k}").alias("dst")).distinct()
        edges = pair if edges is None else edges.union(pair)
    found = shared(connected_components(edges if edges is not None else linked.select(F.col("__n0").alias("src"), F.col("__n0").alias("dst"))))
    found = found.select(F.col("node").alias("__node"), F.col("component").alias("__component"))
    return [t.join(found, "__node").drop("__node") for t in levels]


def level_components(df: DataFrame, effects: list[Effect], name: str = "component") -> list[DataFrame]:
    """Per effect its keys and `name`, a number: levels of all effects are linked when they share a row."""
    every = list(dict.fromkeys(k for e in effects for k in e.keys))
    if name in every:
        raise ValueError(f"the column {name} of the result is named like a key")
    plain = df.select(*[column(c).alias(f"__k{j}") for j, c in enumerate(every)])
    found = linked_levels(plain, [[f"__k{every.index(c)}" for c in e.keys] for e in effects])
    return [t.select(*[F.col(f"__k{every.index(c)}").alias(c) for c in e.keys], F.col("__component").alias(name)) for e, t in zip(effects, found, strict=True)]


def components(df: DataFrame, effects: list[Effect]) -> DataFrame:
    """(effect, level, component): as level_components, in one table; level is the key tuple as JSON."""
    out, name = None, "component"
    while any(name in e.keys for e in effects):
        name += "_"
    for k, (e, t) in enumerate(zip(effects, level_components(df, effects, name), strict=True)):
        one = t.select(F.lit(k).alias("effect"), F.to_json(F.struct(*[column(c) for c in e.keys])).alias("level"), column(name).alias("component"))
        out = one if out is None else out.union(one)
    return out


def by_precision(options: dict) -> dict:
    """One-shot calls end at 1e-8, or 1e-6 in 32 bits, and after 10,000 steps."""
    return {"tol": 1e-8 if options.get("double_precision", True) else 1e-6, "maxiter": 10_000} | {k: v for k, v in options.items() if k != "tol" or v is not None}


def absorb(df: DataFrame, outcomes: list[str], effects: list[Effect], weight: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Residual columns and the statistics of the solver, in one call."""
    a = Absorber(df, effects, weight, **by_precision(options))
    return a.residuals(outcomes), a.statistics()


def coefficients(df: DataFrame, y: str, effects: list[Effect], weight: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Each row's level coefficients and the statistics of the solver, in one call."""
    a = Absorber(df, effects, weight, **by_precision(options))
    return a.coefficients(y), a.statistics()
