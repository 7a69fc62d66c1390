"""Closed forms of shared keys, packed designs, and the solver's public options, against dense least squares."""

import logging

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sorbus.operators import absorb as module
from sorbus.operators.absorb import Absorber, Effect, components, encode, level_components
from sorbus.plans import blocks, packed, queries
from sorbus.plans.lsmr import Rule, lsmr
from sorbus.plans.spaces import looked_up


def table(n=300, seed=1, **more):
    rng = np.random.default_rng(seed)
    f = pd.DataFrame({"i": np.arange(n), "a": rng.integers(0, 12, n), "b": rng.integers(0, 9, n), "c": rng.integers(0, 4, n), "x": rng.normal(size=n), "z": rng.normal(size=n), "w": rng.integers(0, 4, n).astype(float), "y": rng.normal(size=n), "y2": rng.normal(size=n)})
    return f.assign(**more)


def dense(f, effects, y="y", w=None):
    """Residuals by one dense solve; NaN where the weight is 0."""
    columns = []
    for e in effects:
        codes = f.groupby(list(e.keys), sort=True).ngroup().to_numpy()
        columns.append(np.eye(codes.max() + 1)[codes] * (f[e.slope].to_numpy()[:, None] if e.slope else 1.0))
    root = np.sqrt(f[w].to_numpy()) if w else np.ones(len(f))
    d = np.concatenate(columns, 1)
    beta = np.linalg.lstsq(d * root[:, None], f[y].to_numpy() * root, rcond=1e-11)[0]
    return np.where(root > 0, f[y].to_numpy() - d @ beta, np.nan)


def solved(spark, f, effects, ys=("y",), w=None, **options):
    a = Absorber(spark.createDataFrame(f), effects, w, tol=1e-13, **options)
    rows = a.residuals(list(ys)).orderBy("i").toPandas()
    return a, [rows[f"{y}_res"].to_numpy() for y in ys]


A, B, C = Effect("a"), Effect("b"), Effect("c")
SLOPES = [A, Effect("a", slope="x"), Effect("a", slope="z")]


@pytest.mark.parametrize("effects", [SLOPES[:2], SLOPES, SLOPES[1:], [Effect("a", "c"), Effect("c", "a", slope="x")]])
def test_effects_of_one_key(spark, effects):
    for w in (None, "w"):
        f = table(far=1.0)
        a, (got,) = solved(spark, f, effects, w=w)
        np.testing.assert_allclose(got, dense(f, effects, w=w), atol=1e-9)
        assert a.stats["y"].iterations == 1 and a.stats["y"].converged
    one, (here,) = solved(spark, f, effects, w="w", strategy="local")
    np.testing.assert_allclose(here, got, atol=1e-9)


def test_slopes_far_from_zero_and_constant_ones(spark):
    """Years, time stamps, slopes that are the same all over a level, and slopes of nothing but 0."""
    f = table(x=lambda t: 1.7e9 + 1e5 * t["x"], z=lambda t: np.where(t["a"] % 3 == 0, 0.5, np.where(t["a"] % 3 == 1, 0.0, t["z"])))
    near = f.assign(x=(f["x"] - 1.7e9) / 1e5)
    _, (got,) = solved(spark, f, SLOPES)
    np.testing.assert_allclose(got, dense(near, SLOPES), atol=1e-6)
    level = table(z=lambda t: t["a"] * 1.0)
    a = Absorber(spark.createDataFrame(level), [A, Effect("a", slope="z")])
    tables = [t.orderBy("a").toPandas()["coef"].to_numpy() for t in a.level_coefficients("y")]
    mean, n = level.groupby("a")["y"].mean().to_numpy(), np.arange(12)
    # Of the solutions, the shortest in scaled columns: both columns carry half, but where the slope is 0.
    np.testing.assert_allclose(tables[0], np.where(n == 0, mean, mean / 2), atol=1e-9)
    np.testing.assert_allclose(tables[1], np.divide(mean / 2, n, out=np.zeros(12), where=n > 0), atol=1e-9)


def test_roots_make_columns_orthonormal():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 20, 3))
    x[1, :, 2] = 2 * x[1, :, 0]
    x[2] = 0
    gram = np.einsum("lnp,lnq->lpq", x, x)
    root, inverse = blocks.roots(gram)
    made = np.einsum("lnp,lpq->lnq", x, root)
    for level, rank in enumerate((3, 2, 0, 3, 3)):
        eye = made[level].T @ made[level]
        np.testing.assert_allclose(np.sort(np.diag(eye)), [0] * (3 - rank) + [1] * rank, atol=1e-9)
        np.testing.assert_allclose(eye - np.diag(np.diag(eye)), 0, atol=1e-9)
    np.testing.assert_allclose(np.einsum("lpq,lqr->lpr", root, inverse)[[0, 3, 4]], np.broadcast_to(np.eye(3), (3, 3, 3)), atol=1e-9)
    assert (blocks.roots(np.array([[[4.0]], [[0.0]]]))[0].ravel() == [0.5, 0]).all()


@pytest.mark.parametrize("effects", [[A, B], [A, B, C], [*SLOPES[:2], B], [Effect("a", "c"), Effect("b", slope="x"), B]])
def test_packed_designs(spark, effects, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 40)
    monkeypatch.setattr(packed, "SEGMENT", 5)
    f = table()
    a, got = solved(spark, f, effects, ("y", "y2"), "w", strategy="packed")
    here, want = solved(spark, f, effects, ("y", "y2"), "w", strategy="local")
    np.testing.assert_allclose(got, want, atol=1e-10)
    np.testing.assert_allclose(got[0], dense(f, effects, w="w"), atol=1e-8)
    assert all(abs(a.stats[y].iterations - here.stats[y].iterations) <= 1 and a.stats[y].converged for y in ("y", "y2"))


def test_packed_designs_that_fit_exactly(spark):
    f = table(y=lambda t: 1.0 * t["a"] - 2.0 * t["b"], y2=0.0)
    a, got = solved(spark, f, [A, B], ("y", "y2"), strategy="packed")
    np.testing.assert_allclose(got, 0, atol=1e-7)
    assert a.stats["y"].converged and a.stats["y2"].iterations <= 1
    empty = Absorber(spark.createDataFrame(f).limit(0), [A, B], strategy="packed").residuals(["y"])
    assert empty.count() == 0


def test_weights_change_without_regrouping(spark):
    f = table(w2=lambda t: 1 + t["z"] ** 2)
    effects = [A, B]
    a = Absorber(spark.createDataFrame(f), effects, "w", tol=1e-13).prepared()
    for w in ("w", "w2"):
        b = a.with_weight(w)
        rows = b.residuals(["y", "y2"])
        for y in ("y", "y2"):
            np.testing.assert_allclose(rows.orderBy("i").toPandas()[f"{y}_res"].to_numpy(), dense(f, effects, y, w), atol=1e-9)
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and b.design is a.design and b.design.codes[0] in plan
        tables = b.level_coefficients("y")
        fit = rows.join(tables[0].withColumnRenamed("coef", "p"), "a").join(tables[1].withColumnRenamed("coef", "q"), "b")
        assert fit.where("w > 0").agg(F.max(F.abs(F.col("y") - F.col("p") - F.col("q") - F.col("y_res")))).first()[0] < 1e-9
    assert a.size() == (300, [12, 9])
    one = Absorber(spark.createDataFrame(f), SLOPES, "w").prepared().with_weight("w2")
    np.testing.assert_allclose(one.residuals(["y"]).orderBy("i").toPandas()["y_res"], dense(f, SLOPES, w="w2"), atol=1e-9)
    assert one.stats["y"].iterations == 1


def test_prepared_tables_with_nulls(spark):
    f = table()
    df = spark.createDataFrame(f).withColumn("y", F.when(F.col("i") != 5, F.col("y"))).withColumn("w", F.when(F.col("i") == 7, -1.0).otherwise(F.col("w")))
    with pytest.raises(ValueError, match="null or NaN"):
        Absorber(df, [A, B]).prepared().residuals(["y"])
    with pytest.raises(ValueError, match="negative"):
        Absorber(df, [A, B], "w").prepared().residuals(["y2"])
    rows = Absorber(df, [A, B], nulls="drop", tol=1e-13).prepared().residuals(["y"]).orderBy("i").toPandas()
    np.testing.assert_allclose(rows["y_res"], dense(f[f["i"] != 5], [A, B]), atol=1e-9)


def test_a_hot_level_spreads(spark, monkeypatch):
    """Half of all rows at one level: no block, and no partition, holds them together."""
    monkeypatch.setattr(packed, "BLOCK", 1000)
    rng = np.random.default_rng(4)
    n = 40_000
    f = pd.DataFrame({"c0": np.where(rng.random(n) < 0.5, 7, rng.integers(0, 500, n)), "c1": rng.integers(0, 3000, n), "n0": 1.0})
    held = packed.packed(spark.createDataFrame(f).repartition(8), ["c0", "c1"], ["n0"]).df
    parts = sorted(r.n for r in held.groupBy(F.input_file_name().alias("f")).agg(F.sum("n").alias("n")).collect())
    assert sum(parts) == n and len(parts) == 4 and parts[-1] <= 2 * parts[len(parts) // 2]


def test_one_pass_a_round_and_no_exchange_of_rows(spark, monkeypatch):
    """Each product of a round is one scan of the blocks; what is shuffled is a row per segment and task."""
    plans = []
    real = type(spark.range(1)).collect

    def collect(self):
        plan = self._jdf.queryExecution().executedPlan().toString()
        if "sums" in self.columns:
            plans.append(plan)
        return real(self)

    monkeypatch.setattr(type(spark.range(1)), "collect", collect)
    a = Absorber(spark.createDataFrame(table()), [A, B, C], "w", tol=1e-12, strategy="packed")
    a.residuals(["y", "y2"])
    rounds = max(s.iterations for s in a.stats.values())
    assert rounds <= len(plans) <= rounds + 4  # the Gram matrices, A'b and the first residual besides
    for plan in plans:
        assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning(segment") == 1 and "Join" not in plan


HELPERS = ["ss", "s0", "coef", "component", "node", "__w", "__k0", "__x0", "__y0", "__b0_0", "__code", "__s", "__id", "a.b", "`x`", "c0", "n", "code", "level", "__a", "__ak0", "scale", "sums"]


def test_keys_of_any_name(spark):
    f = table()
    want = {s: dense(f, e) for s, e in (("one", [A]), ("two", [A, B]))}
    for name in HELPERS:
        df = spark.createDataFrame(f).coalesce(1).withColumnRenamed("a", name)
        one = Absorber(df, [Effect(name)]).residuals(["y"]).orderBy("i").toPandas()
        np.testing.assert_allclose(one["y_res"], want["one"], atol=1e-9, err_msg=name)
        assert name in one.columns and len(one.columns) == len(f.columns) + 1
    for name, strategy in (("node", "local"), ("__w", "local"), ("a.b", "packed"), ("__b0_0", "packed")):
        df = spark.createDataFrame(f).withColumnRenamed("a", name)
        rows = Absorber(df, [Effect(name), B], strategy=strategy, tol=1e-13).residuals(["y"]).orderBy("i").toPandas()
        np.testing.assert_allclose(rows["y_res"], want["two"], atol=1e-9, err_msg=name)
    assert components(spark.createDataFrame(f).withColumnRenamed("a", "component"), [Effect("component"), B]).count() == 12 + 9
    df = spark.createDataFrame(f).withColumnsRenamed({"a": "coef", "c": "coef1"})
    rows = Absorber(df, [Effect("coef"), B], tol=1e-13).coefficients("y")
    assert rows.columns.count("coef1") == 1 and "coef2" in rows.columns
    with pytest.raises(ValueError, match="named like"):
        Absorber(df, [Effect("coef")]).level_coefficients("y")
    assert Absorber(df, [Effect("coef")]).level_coefficients("y", name="value")[0].columns == ["coef", "value"]
    with pytest.raises(ValueError, match="named like"):
        Absorber(df, [Effect("coef1"), B]).coefficients("y")
    with pytest.raises(ValueError, match="named like"):
        level_components(df.withColumnRenamed("b", "component"), [Effect("coef"), Effect("component")])
    with pytest.raises(ValueError, match="named like"):
        encode(df, Effect("coef"), "coef")


def test_coefficients_of_three_effects(spark):
    f = table()
    a = Absorber(spark.createDataFrame(f), [A, B, C], "w", tol=1e-13)
    rows = a.coefficients("y").orderBy("i").toPandas()
    fit = rows[["coef1", "coef2", "coef3"]].sum(axis=1).to_numpy()
    use = f["w"].to_numpy() > 0
    np.testing.assert_allclose((f["y"] - fit)[use], dense(f, [A, B, C], w="w")[use], atol=1e-9)
    for key, name in (("b", "coef2"), ("c", "coef3")):  # one component: levels of the later effects have mean 0
        assert rows.groupby(key)[name].first().mean() == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("strategy", ["auto", "packed"])
def test_a_solve_goes_on_from_coefficients(spark, strategy):
    f = table()
    df = spark.createDataFrame(f)
    few = Absorber(df, [A, B], maxiter=3, strategy=strategy)
    begun = few.level_coefficients("y")
    assert not few.stats["y"].converged
    whole = Absorber(df, [A, B], tol=1e-10, strategy=strategy)
    whole.level_coefficients("y")
    on = Absorber(df, [A, B], tol=1e-10, strategy=strategy, start={"y": begun})
    np.testing.assert_allclose(on.residuals(["y"]).orderBy("i").toPandas()["y_res"], dense(f, [A, B]), atol=1e-8)
    assert on.stats["y"].iterations < whole.stats["y"].iterations and on.stats["y"].converged
    want = [t.orderBy(t.columns[0]).toPandas()["coef"] for t in Absorber(df, [A, B], tol=1e-13).level_coefficients("y")]
    for t, w in zip(on.level_coefficients("y"), want, strict=True):
        np.testing.assert_allclose(t.orderBy(t.columns[0]).toPandas()["coef"], w, atol=1e-7)


@pytest.mark.parametrize("strategy", ["auto", "local", "packed"])
def test_damping(spark, strategy):
    f, damp = table(), 0.7
    for effects in ([Effect("a", slope="x")], [A, B], SLOPES[:2]):
        columns = []
        for e in effects:
            codes = f[e.keys[0]].to_numpy()
            d = np.eye(codes.max() + 1)[codes] * (f[e.slope].to_numpy()[:, None] if e.slope else 1.0)
            columns.append(d / np.linalg.norm(d, axis=0))
        d = np.concatenate(columns, 1)
        z = np.linalg.solve(d.T @ d + damp**2 * np.eye(d.shape[1]), d.T @ f["y"].to_numpy())
        _, (got,) = solved(spark, f, effects, damp=damp, strategy=strategy)
        np.testing.assert_allclose(got, f["y"].to_numpy() - d @ z, atol=1e-9)
    with pytest.raises(ValueError, match="damp"):
        Absorber(spark.createDataFrame(f), [A], damp=-1)


def test_subsets_by_position(spark):
    f = table()
    df = spark.createDataFrame(f).coalesce(1)
    a = Absorber(df, [A, B])
    at = lambda rows: [r.i for r in a.subset(rows).df.orderBy("i").select("i").collect()]
    order = [r.i for r in df.collect()]
    assert at(range(2, 50, 7)) == sorted(order[2:50:7]) and at(range(9, -1, -3)) == sorted(order[9::-3])
    assert at([5, 0, -1]) == sorted([order[5], order[0], order[-1]]) and at([]) == [] and at(range(0)) == []
    assert at("i < 3") == at(F.col("i") < 3) == [0, 1, 2]
    for bad in ([300], [-301], range(290, 301)):
        with pytest.raises(IndexError, match="of 300 rows"):
            a.subset(bad)
    part = a.subset(range(10))
    assert part.size() == (10, [12, 9]) and part.subset("i < 4").size()[1] == [12, 9]
    coef = part.level_coefficients("y")[0].toPandas().set_index("a")["coef"]
    assert len(coef) == 12 and (coef[~coef.index.isin(f["a"][:10])] == 0).all()


def test_progress_is_told_of_long_solves_only(spark, monkeypatch, caplog):
    df = spark.createDataFrame(table())
    with caplog.at_level(logging.INFO, logger="sorbus"):
        Absorber(df, [A, B], local_bytes=1 << 20).residuals(["y"])
        assert not caplog.records
        monkeypatch.setattr(module, "QUIET_SECONDS", -1.0)
        Absorber(df, [A, B], progress=False).residuals(["y"])
        assert not caplog.records
        a = Absorber(df, [A, B])
        a.residuals(["y"])
    told = [r.getMessage() for r in caplog.records]
    assert len(told) == a.stats["y"].iterations - 1 and told[0] == "step 1, 1 of 1 outcomes left" and told[-1].endswith("0 of 1 outcomes left")


def test_strategies_by_measured_size(spark, monkeypatch):
    used = []
    for name in ("local", "pack", "by_component", "distributed"):
        monkeypatch.setattr(Absorber, name, lambda self, *a, name=name: used.append(name) or [])
    df = spark.createDataFrame(table())
    for options in ({}, {"local_bytes": 0}, {"local_bytes": 0, "level_bytes": 10}, {"local_bytes": 0, "double_precision": False}):
        Absorber(df, [A, B], **options).raw_coefficients(["y"], True)
    assert used == ["local", "pack", "by_component", "distributed"]


def test_neighbours_that_agree_become_one_cell():
    rng = np.random.default_rng(6)
    c0, x = np.sort(rng.integers(0, 5, 60)), rng.integers(0, 2, 60).astype(float)
    w, wy = rng.random(60), rng.random(60)
    made = packed.merged_cells([c0, x, w, wy], [False, False, True, True])
    assert len(made[0]) < 60 and made[2].sum() == pytest.approx(w.sum())
    same = lambda c, s, v: [v[(c == a) & (s == b)].sum() for a in range(5) for b in (0, 1)]
    np.testing.assert_allclose(same(made[0], made[1], made[3]), same(c0, x, wy))
    assert ((np.diff(made[0]) != 0) | (np.diff(made[1]) != 0)).all()


def test_components_are_solved_where_they_lie(spark, monkeypatch):
    """Thousands of small components and one large one: the driver gets no cell, and only the large one goes further."""
    rng = np.random.default_rng(9)
    small = pd.DataFrame({"a": np.repeat(np.arange(1000), 4), "b": np.repeat(np.arange(1000) * 2, 4) + rng.integers(0, 2, 4000), "x": rng.normal(size=4000)})
    big = pd.DataFrame({"a": 5000 + rng.integers(0, 12, 600), "b": 5000 + rng.integers(0, 9, 600), "x": rng.normal(size=600)})
    f = pd.concat([small, big], ignore_index=True).assign(i=range(4600), y=rng.normal(size=4600), w=rng.integers(0, 3, 4600).astype(float))
    calls, real = [], Absorber.distributed
    monkeypatch.setattr(Absorber, "distributed", lambda self, cells, *a: calls.append(cells.count()) or self.local(cells, *a))
    want = {}
    for w in (None, "w"):
        _, (want[w],) = solved(spark, f, [A, B], w=w, strategy="local")
        a, (got,) = solved(spark, f, [A, B], w=w, strategy="components")
        np.testing.assert_allclose(got, want[w], atol=1e-9)
        assert a.stats["y"].converged and not calls
    monkeypatch.setattr(module, "COMPONENT_ROWS", 50)
    a, (got,) = solved(spark, f, [A, B, Effect("b", slope="x")], strategy="components")
    _, (all_,) = solved(spark, f, [A, B, Effect("b", slope="x")], strategy="local")
    np.testing.assert_allclose(got, all_, atol=1e-8)
    assert len(calls) == 1 and 90 < calls[0] <= 600 and a.stats["y"].converged and real
    b = Absorber(spark.createDataFrame(f), [A, B], tol=1e-13, strategy="components")
    c = Absorber(spark.createDataFrame(f), [A, B], tol=1e-13, strategy="local")
    for s, t in zip(b.level_coefficients("y"), c.level_coefficients("y"), strict=True):
        key = s.columns[0]
        np.testing.assert_allclose(s.orderBy(key).toPandas()["coef"], t.orderBy(key).toPandas()["coef"], atol=1e-7)


@pytest.mark.parametrize("effects", [[A, B], [A, B, C], [Effect("a", slope="x"), B, Effect("b", slope="z")], [A, Effect("d")]])
def test_the_largest_effect_is_eliminated(spark, effects, monkeypatch):
    """The driver's vectors are of the other effects; nested ones (each a has one d), heavy levels and weights of 0 included."""
    monkeypatch.setattr(packed, "BLOCK", 40)
    f = table(d=lambda t: t["a"] % 3)
    _, want = solved(spark, f, effects, ("y", "y2"), "w", strategy="local")
    monkeypatch.setattr(module, "ELIMINATED", 12)
    sizes, real = [], packed.LevelSpace.__init__
    monkeypatch.setattr(packed.LevelSpace, "__init__", lambda self, *a: real(self, *a) or sizes.append(self.edges[-1]))
    a, got = solved(spark, f, effects, ("y", "y2"), "w", strategy="packed")
    np.testing.assert_allclose(got, want, atol=1e-10)
    assert sizes == [sum(f[e.keys[0]].nunique() for e in effects[1:])] and all(a.stats[y].converged for y in ("y", "y2"))
    b = Absorber(spark.createDataFrame(f), effects, "w", tol=1e-13).prepared()
    np.testing.assert_allclose(b.residuals(["y2"]).orderBy("i").toPandas()["y2_res"], want[1], atol=1e-10)
    for w in (a, b) if len(effects) == 2 else ():
        for s, t in zip(w.level_coefficients("y"), Absorber(spark.createDataFrame(f), effects, "w", tol=1e-13).level_coefficients("y"), strict=True):
            np.testing.assert_allclose(s.orderBy(s.columns[0]).toPandas()["coef"], t.orderBy(s.columns[0]).toPandas()["coef"], atol=1e-9)
    monkeypatch.setattr(packed, "BLOCK", 5)
    assert Absorber(spark.createDataFrame(f), [A, B]).largest([12, 9]) == 0
    monkeypatch.setattr(module, "BLOCK", 5)
    assert Absorber(spark.createDataFrame(f), [A, B]).largest([12, 9]) is None  # a level's rows are more than are sorted together


class Held(packed.LevelSpace):
    """Two effects' rows as arrays, with the recurrence of packed designs."""

    def __init__(self, codes, y, levels):
        self.codes, self.y = codes, y
        super().__init__([packed.Term(c, None, 0) for c in codes], levels, 1, {c: np.bincount(g, minlength=levels[c]).astype(float)[:, None, None] for c, g in codes.items()}, True)

    def products(self, which, values, rest):
        z = self.level_product(values[0], False)
        r = sum(z[self.edges[k] : self.edges[k + 1]][g] for k, g in enumerate(self.codes.values()))
        r = self.y - r if rest else r
        return [self.level_product(np.concatenate([np.bincount(g, r, self.levels[c]) for c, g in self.codes.items()]), True)], [float(r @ r)]


@pytest.mark.parametrize("kind", ["binary", "nested"])
def test_rounding_makes_no_steps(kind):
    """v ends after a few steps; what rounding leaves of it is no new one, and x stays within reach."""
    for seed in (0, 1):
        rng = np.random.default_rng(seed)
        n, a = 60_000, rng.integers(0, 2000, 60_000)
        b = a % 25 if kind == "nested" else (rng.random(n) < 0.5).astype(int)
        space, rule = Held({"c0": a, "c1": b}, 10 + rng.normal(size=n), {"c0": 2000, "c1": int(b.max()) + 1}), Rule(1e-14, 1e-14)
        steps = lsmr(space, rule)[0].iterations
        while space.restarted(1e-11):
            steps += lsmr(space, rule)[0].iterations
            assert steps < 40
        assert np.linalg.norm(space.x[0]) < 1e7 and space.slopes[0] <= 1e-11


def test_a_pass_reads_few_blocks_at_once(spark):
    """What a task holds follows from READ, not from its partition; the session's own setting comes back, also after an error."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.range(0, 50, 1, 1)
    seen = lambda: [r.n for r in rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long").collect()]
    before, whole = spark.conf.get(key), seen()
    with packed.few_at_once(spark):
        few = seen()
    assert whole == [50] and max(few) == packed.READ and sum(few) == 50 and spark.conf.get(key) == before
    with pytest.raises(ZeroDivisionError), packed.few_at_once(spark):
        1 / 0
    assert spark.conf.get(key) == before


def test_passes_read_under_that_bound(spark, monkeypatch):
    monkeypatch.setattr(packed, "BLOCK", 20)
    monkeypatch.setattr(module, "ELIMINATED", 12)
    bounds, key = [], "spark.sql.execution.arrow.maxRecordsPerBatch"
    for cls, name in ((packed.Pass, "run"), (packed.PackedSpace, "eliminated")):
        monkeypatch.setattr(cls, name, lambda self, *a, real=getattr(cls, name): (bounds.append(spark.conf.get(key)), real(self, *a))[1])
    real = packed.few_at_once
    monkeypatch.setattr(packed, "few_at_once", lambda s: bounds.append("few") or real(s))
    f = table()
    _, (want,) = solved(spark, f, [A, B], strategy="local")
    _, (got,) = solved(spark, f, [A, B], strategy="packed")
    np.testing.assert_allclose(got, want, atol=1e-9)
    assert bounds.count("few") * 2 == len(bounds) > 4 and spark.conf.get(key) not in ("4", "few")


def test_tables_beyond_some_megabytes_stay_off_the_driver(spark):
    df, t = spark.createDataFrame(table()), spark.createDataFrame(pd.DataFrame({"a": [1], "v": [1.0]}))
    hinted = lambda size: "broadcast" in looked_up(df, t, ["a"], size=size)._jdf.queryExecution().logical().toString()
    assert hinted(1 << 20) and not hinted(20 << 20)
    matched = lambda size: "broadcast" in Absorber(df, [A, B]).matched(df, t.withColumnRenamed("a", "__k0"), [0], size)._jdf.queryExecution().logical().toString()
    assert matched(1 << 20) and not matched(20 << 20)


@pytest.fixture(scope="module")
def many_parts(tmp_path_factory):
    """A folder of lineitem alone: 60,000 parts of 4 rows, 300 suppliers."""
    rng, n, d = np.random.default_rng(11), 240_000, tmp_path_factory.mktemp("parts")
    columns = {"l_orderkey": np.arange(n), "l_partkey": np.arange(n) % 60_000, "l_suppkey": rng.integers(0, 300, n), "l_linenumber": rng.integers(1, 8, n).astype(np.int32), "l_quantity": rng.integers(0, 51, n).astype(float)}
    pq.write_table(pa.table(columns | {"l_extendedprice": rng.lognormal(9, 1, n)}), d / "lineitem.parquet")
    return str(d)


def results_of_stages(spark):
    """Bytes of results that tasks have sent to the driver, by stage."""
    jvm = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, jvm.new_array(jvm.jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).resultSize() for i in range(stages.size())}


@pytest.mark.parametrize(("name", "plain"), [("q09_two_way_weighted", "q09_two_way_weighted"), ("q10_three_way", "q10_three_way"), ("q23_orthogonality", "q23_orthogonality"), ("q29_two_way_packed", "q08_two_way")])
def test_rounds_send_the_driver_no_vectors_of_the_largest_effect(spark, many_parts, monkeypatch, name, plain):
    """What the driver gets are a few tables of the parts, on their way to executors; not 480 kB a round."""
    rows = lambda df: df.toPandas().sort_values(df.columns[0]).to_numpy(float)
    want = rows(queries.QUERIES[plain](spark, many_parts))  # solved by the driver
    monkeypatch.setitem(queries.TIGHT, "local_bytes", 0)
    made, real = [], module.PackedSpace.__init__
    monkeypatch.setattr(module.PackedSpace, "__init__", lambda self, *a, **k: made.append(self) or real(self, *a, **k))
    before = results_of_stages(spark)
    out = queries.QUERIES[name](spark, many_parts)
    sent = sum(size for s, size in results_of_stages(spark).items() if s not in before)
    assert len(made) == 1 and sent < 3 << 20
    np.testing.assert_allclose(rows(out), want, atol=1.01e-4)
