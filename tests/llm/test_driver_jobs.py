"""Jobs that the iterative steps send: each stage costs the driver some MB until its garbage is collected."""

import random
import uuid

from pyspark.sql import functions as F

from noticeflow.llm import common, jaccard, quality_rules


def job_number(spark):
    """The number of a job sent now; jobs are numbered in order."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "")
    sc.parallelize([1], 1).count()
    return max(sc.statusTracker().getJobIdsForGroup(group))


def test_components_of_a_path_take_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    before = job_number(spark)
    got = sorted(map(tuple, jaccard.components(edges).collect()))
    assert job_number(spark) - before - 1 <= 65  # 84 with a job for each state and both directions of the edges read apart
    assert got == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]


def test_estimates_take_few_jobs(spark):
    rng = random.Random(3)
    rows = [(g, *[rng.randint(0, 3000) for _ in range(5)]) for g in ("p", "q") for _ in range(200)]
    points = common.written(spark.createDataFrame(rows, "g string, x0 int, x1 int, x2 int, x3 int, x4 int"), "points")
    before = job_number(spark)
    assert sorted((r["g"], r["n"]) for r in quality_rules.robust(points).collect()) == [("p", 200), ("q", 200)]
    assert job_number(spark) - before - 1 <= 70  # 90 with windows for medians and jobs that count what was just written


def test_middle_is_the_least_value_that_half_do_not_exceed(spark):
    rng = random.Random(4)
    groups = {k: [rng.randint(-3, 3) * rng.choice([1, 1000]) for _ in range(n)] for k, n in enumerate([1, 2, 3, 4, 7, 10, 101, 300])}
    values = spark.createDataFrame([(k, x) for k, xs in groups.items() for x in xs], "k int, x int")
    got = quality_rules._middle(values, ["k"], "x", "middle")
    assert got.schema["middle"].dataType.simpleString() == "int"
    assert {r["k"]: r["middle"] for r in got.collect()} == {k: sorted(xs)[(len(xs) - 1) // 2] for k, xs in groups.items()}


def test_measures_of_what_is_written(spark):
    rows = spark.range(10)
    out, seen = common.written_measured(rows, "ten", n=F.count("*"), odd=F.count_if(F.col("id") % 2 == 1))
    assert (out.count(), seen["n"], seen["odd"]) == (10, 10, 5)
    out, seen = common.written_measured(rows.where("id > 10").groupBy("id").agg(F.count("*").alias("c")), "none", n=F.count("*"))
    assert (out.count(), seen["n"]) == (0, 0)
