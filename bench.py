"""Seconds of the headline queries, of the published problems and of gathers, as one line of JSON.

`value` is the sum over the headline queries; the others are listed beside them. Each is run twice, the second run counts.
"""

import json
import os
import time

from pyspark.sql import SparkSession
from sorbus.operators.absorb import Absorber
from sorbus.plans import problems
from sorbus.plans import queries as registered

HEADLINE = ("q01_one_way", "q06_intercept_slope", "q08_two_way", "q09_two_way_weighted", "q10_three_way", "q14_coef_two_way")
#: Generated problem, its options, as the published timings have them.
PROBLEMS = {
    "simple": (problems.simple, {"tol": 1e-8}),
    "hard": (problems.hard, {"tol": 1e-8, "maxiter": 300}),
    "hard_32": (problems.hard, {"tol": 1e-6, "double_precision": False}),
    "interacted": (problems.interacted, {"tol": 1e-8, "maxiter": 300}),
}
#: The same from rows packed into blocks, and headline queries so; a round's seconds are those of a solve of ROUNDS less one of fewer.
PACKED = {"simple_packed": (problems.simple, {"tol": 1e-8, "strategy": "packed"})}
PACKED_QUERIES = ("q29_two_way_packed", "q32_coef_packed")
ROUNDS = 20


def timed(make) -> float:
    for _ in range(2):
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        took = time.time() - start
    return round(took, 3)


if __name__ == "__main__":
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {name: timed(lambda name=name: registered.QUERIES[name](spark, sf)) for name in HEADLINE}
    value, steps = round(sum(took.values()), 3), {}
    for name in PACKED_QUERIES:
        took[name] = timed(lambda name=name: registered.QUERIES[name](spark, sf))
    for name, (make, options) in (PROBLEMS | PACKED).items():
        rows, effects = make(spark)
        rows = rows.cache()
        rows.count()
        a = Absorber(rows, effects, **options)
        took[name] = timed(lambda a=a: a.residuals(["y"]))
        steps[name] = a.stats["y"].iterations
        rows.unpersist()
    rows = registered.lineitem(spark, sf).select("l_partkey", "l_suppkey", "y").cache()
    rows.count()
    some = [timed(lambda n=n: Absorber(rows, [registered.PART, registered.SUPP], strategy="packed", tol=0.0, maxiter=n).residuals(["y"])) for n in (2, ROUNDS)]
    took["packed_round"] = round((some[1] - some[0]) / (ROUNDS - 2), 3)
    rows.unpersist()
    for n, groups in problems.GATHERS:
        rows = problems.gather_rows(spark, n, groups).cache()
        rows.count()
        for kind in (problems.gather_hashed, problems.gather_sorted):
            took[f"{kind.__name__}_{n}_{groups}"] = timed(lambda kind=kind, rows=rows: kind(rows))
        rows.unpersist()
    print(json.dumps({"metric": "absorption_total", "value": value, "unit": "sec", "queries": took, "sf": sf, "cpus": cpus, "iterations": steps}))
