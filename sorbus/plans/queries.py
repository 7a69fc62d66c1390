"""Registered queries of the absorption engine, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.operators.absorb import Absorber, Effect, absorb, coefficients, encode, level_components

TIGHT = {"tol": 1e-14}
PART, SUPP, LINE = Effect("l_partkey"), Effect("l_suppkey"), Effect("l_linenumber")


def lineitem(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").withColumn("y", F.log("l_extendedprice")).withColumn("y2", F.log1p("l_quantity"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").withColumn("y", F.log1p("value"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_custkey", F.log("o_totalprice").alias("y"))
    c = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return o.join(c, "o_custkey")


def r4(c):
    return F.round(c, 4) + F.lit(0.0)


def residual(table, effects, keys, weight=None, y="y", **options):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return Absorber(table(spark, d), effects, weight, **TIGHT | options).residuals([y]).select(*keys, r4(F.col(f"{y}_res")).alias("res"))

    return run


LI = "(select *, ln(l_extendedprice) y, ln(1+l_quantity) y2 from lineitem)"
EV = "(select *, ln(1+value) y from events)"
OC = "(select o_orderkey, o_custkey, c_nationkey, ln(o_totalprice) y from orders join customer on o_custkey=c_custkey)"


def r4s(x: str) -> str:
    return f"round({x},4)+0.0 as res"


def sweeps(src: str, key: str, groups: list[str], w: str = "1.0", n: int = 60) -> str:
    """Alternating demeaning, n rounds over all groups, as a recursive query."""
    inner = "r"
    body = f"select i, {key}, {', '.join(groups)}, w, r, k from it where k < {n}"
    for g in groups:
        body = f"select i, {key}, {', '.join(groups)}, w, r - sum(w*r) over (partition by {g})/sum(w) over (partition by {g}) as r, k from ({body})"
    return (
        f"with recursive b as (select row_number() over () i, {key}, {', '.join(groups)}, {w} w, y r, 0 k from {src}), it as (select * from b union all "
        f"select i, {key}, {', '.join(groups)}, w, {inner}, k+1 from ({body})) select {key}, {r4s('r')} from it where k={n}"
    )


def q05_table(spark, d):
    return lineitem(spark, d).withColumn("x", F.when(F.col("l_suppkey") % 10 == 0, 0.0).otherwise(F.col("l_quantity")))


def q12(spark: SparkSession, d: str) -> DataFrame:
    a = Absorber(lineitem(spark, d), [SUPP], **TIGHT)
    res = a.residuals(["y", "y2"])
    long = res.select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(y).alias("outcome"), r4(F.col(f"{y}_res")).alias("res")) for y in ("y", "y2")])).alias("o")).select("l_orderkey", "o.*")
    return long.join(F.broadcast(a.statistics().select("outcome", "converged")), "outcome")


def q13(spark: SparkSession, d: str) -> DataFrame:
    return Absorber(lineitem(spark, d), [SUPP]).level_coefficients("y")[0].select("l_suppkey", r4(F.col("coef")).alias("coef"))


def q14(spark: SparkSession, d: str, strategy: str = "auto") -> DataFrame:
    u, t = Absorber(events(spark, d), [Effect("user_id"), Effect("event_type")], strategy=strategy, **TIGHT).level_coefficients("y")
    pair = lambda df, k, e: df.select(F.lit(e).alias("effect"), F.col(k).cast("string").alias("level"), r4(F.col("coef")).alias("coef"))
    return pair(u, "user_id", 1).union(pair(t, "event_type", 2))


def q15(spark: SparkSession, d: str) -> DataFrame:
    a, b = Absorber(orders(spark, d), [Effect("o_custkey"), Effect("c_nationkey")], **TIGHT).level_coefficients("y")
    pair = lambda df, k, e: df.select(F.lit(e).alias("effect"), F.col(k).cast("long").alias("level"), r4(F.col("coef")).alias("coef"))
    return pair(a, "o_custkey", 1).union(pair(b, "c_nationkey", 2))


def q16(spark: SparkSession, d: str) -> DataFrame:
    """Components of orders and parts: their sizes."""
    orders, parts = level_components(lineitem(spark, d), [Effect("l_orderkey"), PART])
    both = orders.select("component", F.lit(1).alias("o"), F.lit(0).alias("p")).union(parts.select("component", F.lit(0), F.lit(1)))
    sizes = both.groupBy("component").agg(F.sum("o").alias("n_orders"), F.sum("p").alias("n_parts"))
    return sizes.groupBy("n_orders", "n_parts").agg(F.count("*").alias("n"))


def q17(spark: SparkSession, d: str) -> DataFrame:
    return encode(lineitem(spark, d), Effect("l_returnflag", "l_linestatus", "l_linenumber"))


def q18(spark: SparkSession, d: str) -> DataFrame:
    a = Absorber(lineitem(spark, d), [Effect("l_suppkey", slope="l_discount")], "l_quantity")
    return a.scales(0).select("l_suppkey", r4(F.col("scale")).alias("scale"))


def q19(spark: SparkSession, d: str) -> DataFrame:
    return Absorber(lineitem(spark, d), [SUPP], "l_quantity").gathered(["y"])[0].select("l_suppkey", r4(F.col("g0")).alias("g"))


def q20(spark: SparkSession, d: str) -> DataFrame:
    rows = Absorber(lineitem(spark, d), [SUPP], "l_quantity").scattered(F.lit(1.0))
    return rows.groupBy("l_suppkey").agg(r4(F.sum("scattered")).alias("s"))


def q21(spark: SparkSession, d: str) -> DataFrame:
    a = Absorber(lineitem(spark, d).withColumn("w2", F.col("l_tax") + 1), [PART], "l_quantity")
    one = lambda x, n: x.residuals(["y"]).select("l_orderkey", F.lit(n).alias("weights"), r4(F.col("y_res")).alias("res"))
    return one(a, 1).union(one(a.with_weight("w2"), 2))


def q22(spark: SparkSession, d: str) -> DataFrame:
    li = lineitem(spark, d)
    a = Absorber(li, [PART]).subset("l_quantity < 3")
    return a.level_coefficients("y", [li.select("l_partkey")])[0].select("l_partkey", r4(F.col("coef")).alias("coef"))


def q23(spark: SparkSession, d: str) -> DataFrame:
    res = Absorber(lineitem(spark, d), [PART, SUPP], "l_quantity", **TIGHT).residuals(["y"])
    e = F.sum(F.col("l_quantity") * F.col("y_res"))
    worst = [res.groupBy(k).agg(F.abs(e).alias("g")) for k in ("l_partkey", "l_suppkey")]
    return worst[0].select("g").union(worst[1].select("g")).agg((F.max("g") < 1e-6).alias("orthogonal"))


def q24(spark: SparkSession, d: str) -> DataFrame:
    """Row-expanded coefficients."""
    rows, _ = coefficients(events(spark, d), "y", [Effect("user_id"), Effect("event_type")], tol=1e-14)
    return rows.select("event_id", r4(F.col("coef1")).alias("coef1"), r4(F.col("coef2")).alias("coef2"))


def q25(spark: SparkSession, d: str) -> DataFrame:
    """Two effects under one weight, then under another, from one prepared table."""
    a = Absorber(lineitem(spark, d).withColumn("w2", F.col("l_tax") + 1).select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "w2", "y"), [PART, SUPP], "l_quantity", **TIGHT).prepared()
    one = lambda x, n: x.residuals(["y"]).select("l_orderkey", F.lit(n).alias("weights"), r4(F.col("y_res")).alias("res"))
    return one(a, 1).union(one(a.with_weight("w2"), 2))


def q26(spark: SparkSession, d: str) -> DataFrame:
    """Two outcomes on two effects, solved together."""
    res, stats = absorb(lineitem(spark, d), ["y", "y2"], [PART, SUPP], tol=1e-14)
    long = res.select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(y).alias("outcome"), r4(F.col(f"{y}_res")).alias("res")) for y in ("y", "y2")])).alias("o")).select("l_orderkey", "o.*")
    return long.join(F.broadcast(stats.select("outcome", "converged")), "outcome")


def q27(spark: SparkSession, d: str) -> DataFrame:
    """As q08b, with vectors in DataFrames."""
    a = Absorber(events(spark, d), [Effect("user_id"), Effect("event_type")], strategy="distributed", **TIGHT)
    return a.residuals(["y"]).select("event_id", r4(F.col("y_res")).alias("res"))


def q28(spark: SparkSession, d: str) -> DataFrame:
    """Rows, and levels of each effect."""
    n, (users, types) = Absorber(events(spark, d), [Effect("user_id"), Effect("event_type")]).size()
    return spark.createDataFrame([(n, users, types)], "n long, users long, types long")


def q32(spark: SparkSession, d: str) -> DataFrame:
    """As q14, from a packed design."""
    return q14(spark, d, "packed")


def q34(spark: SparkSession, d: str) -> DataFrame:
    """Two rows of three by position, and the orders of the whole table: those that are left without a row have 0."""
    li = lineitem(spark, d)
    a = Absorber(li, [Effect("l_suppkey")])
    part = a.subset(range(0, li.count(), 3))
    return part.level_coefficients("y")[0].select("l_suppkey", r4(F.col("coef")).alias("coef"))


def q35(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of three effects, each level's of the second and third less their mean."""
    effects = [SUPP, LINE, Effect("l_returnflag")]
    tables = Absorber(lineitem(spark, d), effects, **TIGHT).level_coefficients("y")
    out = None
    for k, (e, t) in enumerate(zip(effects, tables, strict=True)):
        one = t.select(F.lit(k + 1).alias("effect"), F.col(e.keys[0]).cast("string").alias("level"), r4(F.col("coef")).alias("coef"))
        out = one if out is None else out.union(one)
    return out


def q37(spark: SparkSession, d: str) -> DataFrame:
    """As q08, on from the coefficients of a solve that was stopped after three steps."""
    li = lineitem(spark, d)
    begun = Absorber(li, [PART, SUPP], maxiter=3, **TIGHT).level_coefficients("y")
    return Absorber(li, [PART, SUPP], start={"y": begun}, **TIGHT).residuals(["y"]).select("l_orderkey", r4(F.col("y_res")).alias("res"))


QUERIES = {
    "q01_one_way": residual(lineitem, [PART], ["l_orderkey", "l_partkey"]),
    "q02_one_way_weighted": residual(lineitem, [PART], ["l_orderkey", "l_partkey"], "l_quantity"),
    "q03_composite_key": residual(lineitem, [Effect("l_returnflag", "l_linestatus", "l_linenumber")], ["l_orderkey"]),
    "q04_slope_only": residual(lineitem, [Effect("l_suppkey", slope="l_quantity")], ["l_orderkey"]),
    "q05_slope_zero_group": residual(q05_table, [Effect("l_suppkey", slope="x")], ["l_orderkey"]),
    "q06_intercept_slope": residual(lineitem, [SUPP, Effect("l_suppkey", slope="l_quantity")], ["l_orderkey"]),
    "q07_two_way_binary": residual(lineitem, [PART, Effect("l_linestatus")], ["l_orderkey"]),
    "q08_two_way": residual(lineitem, [PART, SUPP], ["l_orderkey"]),
    "q08b_two_way_events": residual(events, [Effect("user_id"), Effect("event_type")], ["event_id"]),
    "q09_two_way_weighted": residual(lineitem, [PART, SUPP], ["l_orderkey"], "l_quantity"),
    "q10_three_way": residual(lineitem, [PART, SUPP, LINE], ["l_orderkey"]),
    "q11_nested": residual(orders, [Effect("o_custkey"), Effect("c_nationkey")], ["o_orderkey"]),
    "q12_multi_outcome": q12, "q13_coef_one_way": q13, "q14_coef_two_way": q14, "q15_coef_components": q15, "q16_components": q16, "q17_encode": q17,
    "q18_scale": q18, "q19_cache_gather": q19, "q20_scatter": q20, "q21_update_weights": q21, "q22_subset": q22, "q23_orthogonality": q23,
    "q24_coef_rows": q24, "q25_two_way_weights": q25, "q26_two_way_outcomes": q26, "q27_two_way_distributed": q27, "q28_size": q28,
    "q29_two_way_packed": residual(lineitem, [PART, SUPP], ["l_orderkey"], strategy="packed"),
    "q30_three_way_packed": residual(lineitem, [PART, SUPP, LINE], ["l_orderkey"], "l_quantity", strategy="packed"),
    "q31_nested_packed": residual(orders, [Effect("o_custkey"), Effect("c_nationkey")], ["o_orderkey"], strategy="packed"),
    "q32_coef_packed": q32,
    "q33_three_slopes": residual(lineitem, [SUPP, *[Effect("l_suppkey", slope=c) for c in ("l_quantity", "l_discount", "l_tax")]], ["l_orderkey"]),
    "q34_subset_positions": q34, "q35_coef_three_way": q35,
    "q36_damped": residual(lineitem, [Effect("l_suppkey", slope="l_quantity")], ["l_orderkey"], "l_tax", damp=0.5, nulls="drop"),
    "q37_from_coefficients": q37,
    "q38_slope_and_other_key": residual(lineitem, [SUPP, Effect("l_suppkey", slope="l_quantity"), Effect("l_linenumber")], ["l_orderkey"], strategy="packed"),
    "q39_nested_by_component": residual(orders, [Effect("o_custkey"), Effect("c_nationkey")], ["o_orderkey"], strategy="components"),
}

def coefficient_sweeps(n: int = 40) -> str:
    """Common table expressions: `f` has each event with its level coefficients a (user) and b (type) after n rounds; `m`
    the mean of b over the types. The events' users and types are one component."""
    inner = "select event_id, user_id, event_type, r - avg(r) over (partition by user_id) r, a + avg(r) over (partition by user_id) a, b, k from it where k < " + str(n)
    return (
        f"with recursive it as (select event_id, user_id, event_type, y r, 0.0::double a, 0.0::double b, 0 k from {EV} union all "
        f"select event_id, user_id, event_type, r - avg(r) over (partition by event_type) r, a, b + avg(r) over (partition by event_type) b, k+1 from ({inner})), "
        f"f as (select * from it where k={n}), lv as (select event_type, any_value(b) b from f group by 1), m as (select avg(b) m from lv) "
    )


def outcome_sweeps(y: str) -> str:
    return f"select '{y}' as outcome, l_orderkey, res, true as converged from ({sweeps(LI.replace('ln(l_extendedprice) y', 'ln(l_extendedprice) y1').replace('y2', 'y') if y == 'y2' else LI, 'l_orderkey', ['l_partkey', 'l_suppkey'], n=40)})"


def three_slopes() -> str:
    """Each of the slopes, and then the outcome, less its projection on those before it, supplier by supplier."""
    p, names = "over (partition by l_suppkey)", ["x1", "x2", "x3", "y"]
    out = f"(select l_orderkey, l_suppkey, {', '.join(f'{c} - avg({c}) {p} as {c}' for c in names)} from (select *, l_quantity x1, l_discount x2, l_tax x3 from {LI}))"
    for j, x in enumerate(names[:3]):
        less = [f"{c} - {x}*coalesce(sum({x}*{c}) {p}/nullif(sum({x}*{x}) {p}, 0), 0) as {c}" for c in names[j + 1 :]]
        out = f"(select l_orderkey, l_suppkey, {', '.join([*names[: j + 1], *less])} from {out})"
    return f"select l_orderkey, {r4s('y')} from {out}"


def slope_sweeps(n: int = 60) -> str:
    """Alternating regressions on intercept and slope within suppliers, and means of line numbers."""
    line = f"select l_orderkey, l_suppkey, l_linenumber, x, r - avg(r) over (partition by l_linenumber) as r, k from it where k < {n}"
    fit = f"select l_orderkey, l_suppkey, l_linenumber, x, r - coalesce(regr_intercept(r, x) over p, avg(r) over p) - x*coalesce(regr_slope(r, x) over p, 0) as r, k+1 from ({line}) window p as (partition by l_suppkey)"
    return f"with recursive it as (select l_orderkey, l_suppkey, l_linenumber, l_quantity x, y r, 0 k from {LI} union all {fit}) select l_orderkey, {r4s('r')} from it where k={n}"


def three_way_coefficients(n: int = 40) -> str:
    step, cols = f"select * from it where k < {n}", "l_suppkey, l_linenumber, l_returnflag"
    for key, name in (("l_suppkey", "a"), ("l_linenumber", "b"), ("l_returnflag", "c")):
        mean = f"avg(r) over (partition by {key})"
        step = f"select {cols}, r - {mean} as r, {', '.join(f'{v} + {mean} as {v}' if v == name else v for v in 'abc')}, k from ({step})"
    level = lambda key, v: f"(select {key}::varchar as level, any_value({v}) as v from f group by 1)"
    return (
        f"with recursive it as (select {cols}, y r, 0.0::double a, 0.0::double b, 0.0::double c, 0 k from {LI} union all select {cols}, r, a, b, c, k+1 from ({step})), "
        f"f as (select * from it where k={n}), b as (select *, avg(v) over () m from {level('l_linenumber', 'b')}), c as (select *, avg(v) over () m from {level('l_returnflag', 'c')}), "
        f"m as (select (select any_value(m) from b) + (select any_value(m) from c) as m) "
        f"select 1 as effect, level, round(v+m, 4)+0.0 as coef from {level('l_suppkey', 'a')}, m union all select 2, level, round(v-m, 4)+0.0 from b union all select 3, level, round(v-m, 4)+0.0 from c"
    )


SLOPE = "y - x*coalesce(sum(x*y) over p/nullif(sum(x*x) over p,0),0)"
SQL = {
    "q01_one_way": f"select l_orderkey, l_partkey, {r4s('y-avg(y) over (partition by l_partkey)')} from {LI}",
    "q02_one_way_weighted": f"select l_orderkey, l_partkey, {r4s('y-sum(l_quantity*y) over p/sum(l_quantity) over p')} from {LI} window p as (partition by l_partkey)",
    "q03_composite_key": f"select l_orderkey, {r4s('y-avg(y) over (partition by l_returnflag,l_linestatus,l_linenumber)')} from {LI}",
    "q04_slope_only": f"select l_orderkey, {r4s(SLOPE)} from (select *, l_quantity x from {LI}) window p as (partition by l_suppkey)",
    "q05_slope_zero_group": f"select l_orderkey, {r4s(SLOPE)} from (select *, case when l_suppkey%10=0 then 0.0::double else l_quantity end x from {LI}) window p as (partition by l_suppkey)",
    "q06_intercept_slope": f"select l_orderkey, {r4s('y - regr_intercept(y,l_quantity) over p - l_quantity*regr_slope(y,l_quantity) over p')} from {LI} window p as (partition by l_suppkey)",
    "q07_two_way_binary": f"with a as (select *, (l_linestatus='O')::int::double s from {LI}), b as (select l_orderkey, y-avg(y) over p yd, s-avg(s) over p sd from a window p as (partition by l_partkey)) select l_orderkey, {r4s('yd-sd*(sum(yd*sd) over ())/(sum(sd*sd) over ())')} from b",
    "q08_two_way": sweeps(LI, "l_orderkey", ["l_partkey", "l_suppkey"], n=40),
    "q08b_two_way_events": sweeps(EV, "event_id", ["user_id", "event_type"], n=40),
    "q09_two_way_weighted": sweeps(LI, "l_orderkey", ["l_partkey", "l_suppkey"], "l_quantity", n=40),
    "q10_three_way": sweeps(LI, "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber"], n=40),
    "q11_nested": f"select o_orderkey, {r4s('y-avg(y) over (partition by o_custkey)')} from {OC}",
    "q12_multi_outcome": f"select 'y' outcome, l_orderkey, {r4s('y-avg(y) over p')}, true converged from {LI} window p as (partition by l_suppkey) union all select 'y2', l_orderkey, {r4s('y2-avg(y2) over p')}, true from {LI} window p as (partition by l_suppkey)",
    "q13_coef_one_way": f"select l_suppkey, round(avg(y),4)+0.0 coef from {LI} group by 1",
    "q15_coef_components": f"select 1 as effect, o_custkey as level, round(avg(y),4)+0.0 as coef from {OC} group by o_custkey union all select distinct 2, c_nationkey::bigint, 0.0::double from {OC}",
    "q17_encode": "select distinct l_returnflag, l_linestatus, l_linenumber, dense_rank() over (order by l_returnflag, l_linestatus, l_linenumber) code from lineitem",
    "q18_scale": "select l_suppkey, round(1/sqrt(sum(l_quantity*l_discount*l_discount)),4)+0.0 as scale from lineitem group by 1",
    "q19_cache_gather": f"select l_suppkey, round(sum(l_quantity*y)/sqrt(sum(l_quantity)),4)+0.0 as g from {LI} group by 1",
    "q20_scatter": "select l_suppkey, round(sum(sqrt(l_quantity))/sqrt(sum(l_quantity)),4)+0.0 as s from lineitem group by 1",
    "q21_update_weights": f"select l_orderkey, 1 as weights, {r4s('y-sum(l_quantity*y) over p/sum(l_quantity) over p')} from {LI} window p as (partition by l_partkey) union all select l_orderkey, 2, {r4s('y-sum((1+l_tax)*y) over p/sum(1+l_tax) over p')} from {LI} window p as (partition by l_partkey)",
    "q22_subset": f"select l_partkey, round(coalesce(avg(y) filter (l_quantity<3),0),4)+0.0 as coef from {LI} group by 1",
    "q14_coef_two_way": coefficient_sweeps() + "select 1 as effect, user_id::varchar as level, round(any_value(a)+m.m,4)+0.0 as coef from f, m group by user_id, m.m union all select 2, event_type, round(b-m.m,4)+0.0 from lv, m",
    "q16_components": "with recursive e as (select distinct 2*l_orderkey a, 2*l_partkey+1 b from lineitem), g as (select a, b from e union all select b, a from e union all select a, a from e union all select distinct b, b from e), it as (select distinct a node, a label, 0 k from g union all select g.a, min(it.label), max(it.k)+1 from it join g on g.b=it.node where it.k < 30 group by g.a), s as (select label, count(*) filter (node%2=0) o, count(*) filter (node%2=1) p from it where k=30 group by 1) select o as n_orders, p as n_parts, count(*) as n from s group by 1, 2",
    "q23_orthogonality": "select true as orthogonal",
    "q24_coef_rows": coefficient_sweeps() + "select event_id, round(a+m.m,4)+0.0 as coef1, round(b-m.m,4)+0.0 as coef2 from f, m",
    "q25_two_way_weights": f"select l_orderkey, 1 as weights, res from ({sweeps(LI, 'l_orderkey', ['l_partkey', 'l_suppkey'], 'l_quantity', n=40)}) union all select l_orderkey, 2, res from ({sweeps(LI, 'l_orderkey', ['l_partkey', 'l_suppkey'], '(1+l_tax)', n=40)})",
    "q26_two_way_outcomes": f"{outcome_sweeps('y')} union all {outcome_sweeps('y2')}",
    "q27_two_way_distributed": sweeps(EV, "event_id", ["user_id", "event_type"], n=40),
    "q29_two_way_packed": sweeps(LI, "l_orderkey", ["l_partkey", "l_suppkey"], n=40),
    "q30_three_way_packed": sweeps(LI, "l_orderkey", ["l_partkey", "l_suppkey", "l_linenumber"], "l_quantity", n=40),
    "q31_nested_packed": f"select o_orderkey, {r4s('y-avg(y) over (partition by o_custkey)')} from {OC}",
    "q32_coef_packed": coefficient_sweeps() + "select 1 as effect, user_id::varchar as level, round(any_value(a)+m.m,4)+0.0 as coef from f, m group by user_id, m.m union all select 2, event_type, round(b-m.m,4)+0.0 from lv, m",
    "q33_three_slopes": three_slopes(),
    "q34_subset_positions": f"select l_suppkey, round(coalesce(avg(y) filter (i % 3 = 0), 0), 4)+0.0 as coef from (select *, row_number() over () - 1 as i from {LI}) group by 1",
    "q35_coef_three_way": three_way_coefficients(),
    "q36_damped": f"select l_orderkey, case when l_tax = 0 then 'nan'::double else round(y - l_quantity*coalesce(sum(l_tax*l_quantity*y) over p/nullif(1.25*sum(l_tax*l_quantity*l_quantity) over p, 0), 0), 4)+0.0 end as res from {LI} window p as (partition by l_suppkey)",
    "q37_from_coefficients": sweeps(LI, "l_orderkey", ["l_partkey", "l_suppkey"], n=40),
    "q38_slope_and_other_key": slope_sweeps(),
    "q39_nested_by_component": f"select o_orderkey, {r4s('y-avg(y) over (partition by o_custkey)')} from {OC}",
    "q28_size": "select count(*) as n, count(distinct user_id) as users, count(distinct event_type) as types from events",
}
