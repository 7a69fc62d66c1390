from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sorbus.operators.absorb import Absorber, Effect, absorb, coefficients, components
from sorbus.plans.lsmr import Outcome, Path, Rule, lsmr, rotate
from sorbus.plans.queries import QUERIES, SQL

Y = [0.5548445405298847, 0.9444014472663531, 0.0510866660400604, 0.9415750229576445, 0.697755708534771, 0.9664962514198971, 0.12752269572311858, 0.4633531422366297, 0.03341608526498096, 0.1647934493047556]
ROWS = list(zip(range(1, 11), [1, 1, 2, 2, 3, 3, 4, 4, 5, 5], [1, 2, 3, 4, 5, 1, 2, 3, 4, 5], Y, [float(i) for i in range(1, 11)], [0.2, 0.8, 0.3, 0.7, 0.5, 0.5, 0.4, 0.6, 0.1, 0.9]))
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def ten(spark):
    return spark.createDataFrame(ROWS, "row_id int, p1 int, p2 int, y double, w double, slope double")


def residuals(df, effects, **k):
    return [r.y_res for r in Absorber(df, effects, tol=1e-13, **k).residuals(["y"]).orderBy("row_id").collect()]


@pytest.mark.parametrize("strategy", ["local", "distributed"])
def test_two_way(ten, strategy):
    a = 0.2015993617092465
    assert residuals(ten, [Effect("p1"), Effect("p2")], strategy=strategy) == pytest.approx([-a, a] * 5, abs=1e-9)


def test_weighted_and_slopes(ten):
    assert residuals(ten, [Effect("p1"), Effect("p2")], weight="w")[:2] == pytest.approx([-0.68829479949506, 0.34414739974753], abs=1e-9)
    assert residuals(ten, [Effect("p1")], weight="w")[:2] == pytest.approx([-0.25970460449098, 0.12985230224549], abs=1e-12)
    assert residuals(ten, [Effect("p1", slope="slope")])[:2] == pytest.approx([0.29999452114193, -0.07499863028548], abs=1e-12)
    got = residuals(ten, [Effect("p1"), Effect("p1", slope="slope")])
    assert got == pytest.approx([0, 0, 0, 0, -0.134370271442563, 0.134370271442563, 0, 0, 0, 0], abs=1e-8)


def test_coefficients_normalised(ten):
    one, two = Absorber(ten, [Effect("p1"), Effect("p2")], tol=1e-13).level_coefficients("y")
    assert [r.coef for r in one.orderBy("p1").collect()][0] == pytest.approx(0.8456610642744155)
    assert sum(r.coef for r in two.collect()) == pytest.approx(0, abs=1e-9)


def test_two_components(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0), (2, 2, 5.0), (3, 3, 10.0), (3, 4, 11.0), (4, 3, 13.0), (4, 4, 16.0)], "f1 int, f2 int, y double")
    one, two = Absorber(df, [Effect("f1"), Effect("f2")], tol=1e-13).level_coefficients("y")
    assert [r.coef for r in one.orderBy("f1").collect()] == pytest.approx([1.5, 4, 10.5, 14.5])
    assert [r.coef for r in two.orderBy("f2").collect()] == pytest.approx([-0.75, 0.75, -1, 1])
    assert components(df, [Effect("f1"), Effect("f2")]).select("component").distinct().count() == 2


def test_zero_slope_weight_nulls(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 0.0, 2.0), (2, 1.0, 3.0), (2, 2.0, 5.0)], "k int, x double, y double")
    assert sorted(r.y_res for r in Absorber(df, [Effect("k", slope="x")]).residuals(["y"]).collect()) == pytest.approx([-0.2, 0.4, 1, 2])
    bad = spark.createDataFrame([(1, 1.0), (None, 2.0)], "k int, y double")
    assert Absorber(bad, [Effect("k")], nulls="drop").residuals(["y"]).count() == 1
    with pytest.raises(Exception, match="null or NaN"):
        Absorber(bad, [Effect("k")]).residuals(["y"]).collect()
    with pytest.raises(ValueError, match="no column"):
        Absorber(bad, [Effect("z")])
    assert Absorber(bad.limit(0), [Effect("k")]).residuals(["y"]).count() == 0


@pytest.mark.parametrize("name", list(SQL))
def test_oracle(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    want, got = con.sql(SQL[name]).df(), QUERIES[name](spark, d).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    order = lambda f: f[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=2e-4)


def linked(pairs):
    """Union-find: the root of each node of both sides."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        up[root((0, a))] = root((1, b))
    return {x: root(x) for x in list(up)}


def test_components_of_all_rows(spark, tmp_path):
    rows = duckdb.sql("select l_orderkey, l_partkey from '/root/testdata/sf0.001/lineitem.parquet'").fetchall()
    several = [(o, o % 40 * 3 + o % 3) for o in range(200)] + [(o, o % 40 * 3 + o % 2) for o in range(50)] + [(900, 900), (901, 900), (901, 901)]
    pd.DataFrame(several, columns=["l_orderkey", "l_partkey"]).assign(l_extendedprice=1.0, l_quantity=1.0, l_shipdate=pd.to_datetime("1997-05-05")).to_parquet(tmp_path / "lineitem.parquet", coerce_timestamps="us")
    for d, pairs in (("/root/testdata/sf0.001", rows), (str(tmp_path), several)):
        sizes = Counter(root for root in linked(pairs).values())
        orders = Counter(root for (side, _), root in linked(pairs).items() if side == 0)
        want = Counter((orders[r], n - orders[r]) for r, n in sizes.items())
        got = QUERIES["q16_components"](spark, d).collect()
        assert {(r.n_orders, r.n_parts): r.n for r in got} == want and len(got) == len(want)
    assert sum(want.values()) > 10


def test_two_way_coefficients_dense(spark):
    """q14 against dense least squares, normalised by component: effect 2 has mean 0 over its levels."""
    rows = duckdb.sql("select user_id, event_type, ln(1 + value) from '/root/testdata/sf0.001/events.parquet'").fetchall()
    users, types = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    x = np.zeros((len(rows), len(users) + len(types)))
    for i, (u, t, _) in enumerate(rows):
        x[i, users.index(u)] = x[i, len(users) + types.index(t)] = 1
    coef = np.linalg.lstsq(x, np.array([r[2] for r in rows]), rcond=None)[0]
    assert len(set(linked([r[:2] for r in rows]).values())) == 1
    shift = coef[len(users) :].mean()
    want = {(1, str(u)): c + shift for u, c in zip(users, coef)} | {(2, t): c - shift for t, c in zip(types, coef[len(users) :])}
    got = {(r.effect, r.level): r.coef for r in QUERIES["q14_coef_two_way"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: pytest.approx(v, abs=6e-5) for k, v in want.items()}


def test_strategies_take_the_same_steps(spark, tmp_path):
    """Vectors in arrays and in DataFrames: the same iterations, code and residuals, over a table of 600,000 rows too."""
    rng = np.random.default_rng(8)
    small = pd.DataFrame({"a": rng.integers(0, 40, 400), "b": rng.integers(0, 25, 400), "x": rng.normal(size=400), "w": rng.integers(0, 4, 400).astype(float), "y": rng.normal(size=400), "y2": rng.normal(size=400)})
    effects = [Effect("a"), Effect("b"), Effect("a", slope="x")]
    seen = {}
    for strategy in ("local", "distributed"):
        a = Absorber(spark.createDataFrame(small.assign(i=range(400))), effects, "w", tol=1e-10, strategy=strategy)
        rows = a.residuals(["y", "y2"]).orderBy("i").select("y_res", "y2_res").toPandas()
        seen[strategy] = rows, [tuple(r) for r in a.statistics().orderBy("outcome").collect()]
    assert seen["local"][1] == seen["distributed"][1] and all(r[2] for r in seen["local"][1])
    np.testing.assert_allclose(seen["local"][0], seen["distributed"][0], atol=1e-7)
    assert seen["local"][0]["y_res"].isna().sum() == (small["w"] == 0).sum()
    li = spark.read.parquet("/root/testdata/sf0.1/lineitem.parquet").select("l_suppkey", "l_linenumber", "l_quantity").withColumn("y", F.log1p("l_quantity"))
    both = {}
    for strategy in ("local", "distributed"):
        a = Absorber(li, [Effect("l_suppkey"), Effect("l_linenumber")], strategy=strategy)
        got = a.residuals(["y"]).agg(F.count("*"), F.sum(F.col("y_res") ** 2)).first()
        both[strategy] = a.stats["y"], got
    assert both["local"][0] == both["distributed"][0] and both["local"][1][0] == both["distributed"][1][0] == 600_000
    assert both["local"][1][1] == pytest.approx(both["distributed"][1][1], rel=1e-9)


def test_five_rows_stop_alike(spark):
    df = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0), (2, 1, 4.0), (2, 2, 5.5), (3, 2, 1.0)], "p int, q int, y double")
    stats = []
    for strategy in ("local", "distributed"):
        a = Absorber(df, [Effect("p"), Effect("q")], tol=1e-13, strategy=strategy)
        a.residuals(["y"]).collect()
        stats.append(a.stats["y"])
    assert stats[0] == stats[1] and stats[0].converged
    few = Absorber(df, [Effect("p"), Effect("q")], tol=1e-13, maxiter=2)
    few.residuals(["y"]).collect()
    assert few.stats["y"].istop == 7 and not few.stats["y"].converged


def test_many_outcomes_as_each(ten):
    df = ten.withColumn("y2", F.col("y") * F.col("w") - 1).withColumn("zero", F.lit(0.0))
    together = Absorber(df, [Effect("p1"), Effect("p2")], tol=1e-13)
    rows = together.residuals(["y", "y2", "zero"]).orderBy("row_id").collect()
    for y in ("y", "y2", "zero"):
        alone = Absorber(df, [Effect("p1"), Effect("p2")], tol=1e-13)
        assert [r[f"{y}_res"] for r in alone.residuals([y]).orderBy("row_id").collect()] == pytest.approx([r[f"{y}_res"] for r in rows], abs=1e-11)
        assert together.stats[y] == alone.stats[y]
    assert together.stats["zero"].iterations <= 1 and together.stats["zero"].converged


def test_precision_strategy_size(ten):
    a = 0.2015993617092465
    for strategy in ("local", "distributed"):
        rows, stats = absorb(ten, ["y"], [Effect("p1"), Effect("p2")], double_precision=False, strategy=strategy)
        assert [r.y_res for r in rows.orderBy("row_id").collect()] == pytest.approx([-a, a] * 5, abs=1e-4) and stats.first().converged
    one, _ = absorb(ten, ["y"], [Effect("p1")], strategy="local")
    closed, _ = absorb(ten, ["y"], [Effect("p1")])
    assert [r.y_res for r in one.orderBy("row_id").collect()] == pytest.approx([r.y_res for r in closed.orderBy("row_id").collect()])
    with pytest.raises(ValueError, match="strategy"):
        Absorber(ten, [Effect("p1"), Effect("p2")], strategy="closed_form")
    assert Absorber(ten, [Effect("p1"), Effect("p2")]).size() == (10, [5, 5])
    assert Effect("p1").slope_type(ten).simpleString() == "int" and Effect("p1", slope="slope").slope_type(ten).simpleString() == "double"
    assert repr(Effect("p1", "p2", slope="slope")) == "p1#p2*slope"


def test_coefficients_of_rows(ten):
    rows, stats = coefficients(ten, "y", [Effect("p1"), Effect("p2")], tol=1e-13)
    fit = [r.y - r.coef1 - r.coef2 for r in rows.orderBy("row_id").collect()]
    assert fit == pytest.approx([-0.2015993617092465, 0.2015993617092465] * 5, abs=1e-9) and stats.first().converged


def test_levels_of_signed_zero(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (2, -0.0, 4.0)], "f1 int, f2 double, y double")
    one, two = Absorber(df, [Effect("f1"), Effect("f2")], tol=1e-13).level_coefficients("y")
    assert [r.coef for r in one.orderBy("f1").collect()] == pytest.approx([1.0, 4.0]) and [r.coef for r in two.collect()] == pytest.approx([0.0])


def dense(a, b, damp=0.0):
    return np.linalg.lstsq(np.vstack([a, damp * np.eye(a.shape[1])]), np.append(b, np.zeros(a.shape[1])), rcond=None)[0]


class Dense:
    """A space over one matrix, for the solver alone."""

    def __init__(self, a, bs):
        self.a, self.u = a, [b.copy() for b in bs]
        self.x = [np.zeros(a.shape[1]) for _ in bs]

    def unit(self, x):
        n = np.linalg.norm(x)
        return (x / n if n else x), n

    def start(self):
        self.u, beta = map(list, zip(*map(self.unit, self.u)))
        self.v, alpha = map(list, zip(*[self.unit(self.a.T @ u) for u in self.u]))
        self.h, self.bar = [v.copy() for v in self.v], [np.zeros_like(v) for v in self.v]
        return beta, alpha

    def left(self, which, alpha):
        out = [self.unit(self.a @ self.v[i] - a * self.u[i]) for i, a in zip(which, alpha)]
        for i, (u, _) in zip(which, out):
            self.u[i] = u
        return [n for _, n in out]

    def right(self, which, beta):
        out = [self.unit(self.a.T @ self.u[i] - b * self.v[i]) for i, b in zip(which, beta)]
        for i, (v, _) in zip(which, out):
            self.v[i] = v
        return [n for _, n in out]

    def advance(self, which, keep, move, turn):
        for i, k, m, t in zip(which, keep, move, turn):
            self.bar[i] = self.h[i] - k * self.bar[i]
            self.x[i] = self.x[i] + m * self.bar[i]
            self.h[i] = self.v[i] - t * self.h[i]
        return [np.linalg.norm(self.x[i]) for i in which]


@pytest.mark.parametrize("damp", [0.0, 0.7])
def test_lsmr_parts(damp):
    rng = np.random.default_rng(2)
    a, bs = rng.normal(size=(30, 12)), [rng.normal(size=30), np.zeros(30), rng.normal(size=30)]
    space = Dense(a, bs)
    out = lsmr(space, Rule(1e-13, 1e-13), damp)
    for x, b in zip(space.x, bs):
        np.testing.assert_allclose(x, dense(a, b, damp), atol=1e-9)
    assert out[1] == Outcome(0, True, 0) and all(o.converged for o in out)
    # The estimates against what they estimate, step by step.
    space = Dense(a, bs[:1])
    (beta,), (alpha,) = space.start()
    path = Path(beta, alpha, damp)
    for it in range(1, 9):
        (b,) = space.left([0], [path.alpha])
        (al,) = space.right([0], [b])
        space.advance([0], *([m] for m in path.step(b, al)))
        r = np.append(bs[0] - a @ space.x[0], -damp * space.x[0])
        assert path.r == pytest.approx(np.linalg.norm(r), rel=1e-8)
        assert abs(path.factors.zeta_bar) == pytest.approx(np.linalg.norm(a.T @ r[:30] + damp * r[30:]), rel=1e-6, abs=1e-9)
    assert path.norm <= np.linalg.norm(a) * 1.01 and path.cond <= np.linalg.cond(a) * 1.5
    assert rotate(0, 0) == (1.0, 0.0, 0.0) and rotate(3, 4) == (0.6, 0.8, 5.0)
    assert Rule(1e-8, 1e-8, maxiter=5).code(5, 1, 0, 1, 1, 1, 1) == 7 and Rule(1e-8, 1e-8).code(1, 1, 1e-9, 1, 1, 1, 1) == 2
    assert Rule(1e-8, 1e-8).code(1, 1e-9, 1, 1, 1, 1, 1) == 1 and Rule(1e-8, 1e-8).code(1, 1, 1, 1, 1e9, 1, 1) == 3
