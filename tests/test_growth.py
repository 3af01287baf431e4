"""What a task holds and what moves must not grow where it needn't: plans and steps of queries that would fail on larger tables."""

from pyspark.sql import functions as F

from skein.operators import completion
from skein.plans import catalog
from skein.plans.relations import spark_relation


def physical(spark, sf, name):
    return catalog.QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()


def test_tracking_sorts_no_changes(spark, sf):
    plan = physical(spark, sf, "st1_track_in_file")
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_definition_sections_gather_once(spark, sf):
    plan = physical(spark, sf, "g4_definition_sections")
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert "HashAggregate(keys=[section_id" not in plan  # occurrences aren't made distinct before they are joined


def test_only_sections_that_define_names_have_requirements(spark, sf):
    cache = {}
    R = lambda x: spark_relation(spark, sf, x, cache)
    defs, reqs = catalog.linkable(R)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = R("r_req").join(defs.select("section_id").distinct(), "section_id", "left_semi").select("section_id", "name", "weak")
    assert rows(reqs.select("section_id", "name", "weak")) == rows(want)
    assert 0 < reqs.count() < R("r_req").count()


def test_completions_gather_names_once_for_requests_of_one_closure(spark):
    requests = spark.createDataFrame([(1, 10, 50, "a"), (2, 11, 50, "a"), (3, 12, 50, "a"), (4, 99, 50, "a")], "request_id long, file_id long, pos long, context string")
    occ = spark.createDataFrame(
        [(10, 60, 1, "a1"), (10, 20, 2, "a2"), (10, 60, 3, "a3"), (11, 60, 3, "a3"), (12, 70, 4, "a4"), (12, 70, 5, "b5"), (99, 10, 6, "a6"), (50, 10, 7, "a7"), (10, 2**32, 8, "a8")],
        "file_id long, end long, entity_id long, name string",
    ).select("*", F.lit(1).alias("kind"), F.lit(1).alias("entity_kind"), F.lit(True).alias("instantiated"))
    includes = spark.createDataFrame([(10, 11), (11, 10), (11, 12)], "includer long, included long")
    df = completion.completions(requests, occ, includes)
    # 10 and 11 reach 10, 11 and 12; in a request's own file only what stands before pos counts
    want = {(1, "a2"), (1, "a3"), (1, "a4"), (2, "a1"), (2, "a2"), (2, "a3"), (2, "a4"), (4, "a6")}
    assert {(r.request_id, r.name) for r in df.collect()} == want and df.count() == len(want)
    assert "min(in_file" in df._jdf.queryExecution().optimizedPlan().toString()
