"""Counters, flags and status ladders. Instances are a bag: a header included twice counts twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.kinds import DATA, FUNCTION, USE, VIRTUAL


def instance_counts(instances: DataFrame) -> DataFrame:
    """(occ_id, n, n_linked, instantiated, linked) for instances (occ_id, unit_id, linked)."""
    g = instances.groupBy("occ_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("linked").alias("n_linked"))
    return g.withColumns({"instantiated": F.col("n") > 0, "linked": F.col("n_linked") > 0})


def effective_kind(instances: DataFrame) -> DataFrame:
    """(entity_id, kind): global variable, function or virtual function if the styles of all instances name just one of
    them, global symbol otherwise."""
    has = lambda s: F.bool_or(F.col("style") == s)
    g = instances.groupBy("entity_id").agg(has(DATA).alias("d"), has(FUNCTION).alias("f"), has(VIRTUAL).alias("v"))
    only = F.col("d").cast("int") + F.col("f").cast("int") + F.col("v").cast("int") == 1
    return g.select("entity_id", F.when(only & F.col("d"), 2).when(only & F.col("f"), 3).when(only & F.col("v"), 4).otherwise(1).alias("kind"))


def count_by(df: DataFrame, key: str, name: str = "n") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias(name))


def inclusion_counts(linked_includes: DataFrame, direct_uses: DataFrame) -> DataFrame:
    """(file_id, n, included): linked include instances and uses as makefile or linker script together."""
    both = linked_includes.select("file_id").unionByName(direct_uses.select("file_id"))
    return count_by(both, "file_id").withColumn("included", F.col("n") > 0)


def main_occurrence(occurrences: DataFrame) -> DataFrame:
    """(entity_id, occ_id): the definition or declaration of the lowest kind, else a use; weak uses count as
    declarations. Ties go to the smallest occ_id."""
    rank = F.when(F.col("kind") == USE, 100).otherwise(F.col("kind"))
    return occurrences.groupBy("entity_id").agg(F.min_by("occ_id", F.struct(rank, F.col("occ_id"))).alias("occ_id"))


def has_definition(occurrences: DataFrame) -> DataFrame:
    """(entity_id, has_definition): declarations count."""
    return occurrences.groupBy("entity_id").agg(F.bool_or(F.col("kind") != USE).alias("has_definition"))


def link_status(facts: DataFrame) -> DataFrame:
    """(name, status) for facts (name, fact, n): the ladder of link statuses, the highest rung of a name's facts.

    fact: strong, tentative, weak (definitions in linked sections, n instances), required, weakly_required, builtin,
    script, provide.
    """
    n = lambda f: F.coalesce(F.sum(F.when(F.col("fact") == f, F.col("n"))), F.lit(0))
    g = facts.groupBy("name").agg(*[n(f).alias(f) for f in ("strong", "tentative", "weak", "required", "weakly_required", "builtin", "script", "provide")])
    rung = (
        F.when(F.col("strong") >= 2, 6)
        .when((F.col("strong") == 1) | (F.col("script") > 0), 5)
        .when(F.col("tentative") > 0, 4)
        .when((F.col("weak") > 0) | (F.col("builtin") > 0) | (F.col("provide") > 0), 3)
        .when(F.col("required") > 0, 2)
        .when(F.col("weakly_required") > 0, 1)
        .otherwise(0)
    )
    return g.select("name", rung.alias("status"))


def linker_status(status: DataFrame, defsyms: DataFrame) -> DataFrame:
    """One row (status): 3 (error) if a name is multiply defined, or undefined and no defsym; else 2 (done)."""
    bad = status.join(defsyms.select("name").distinct().withColumn("defsym", F.lit(True)), "name", "left")
    wrong = (F.col("status") == 6) | ((F.col("status") == 2) & F.col("defsym").isNull())
    return bad.agg(F.when(F.coalesce(F.bool_or(wrong), F.lit(False)), 3).otherwise(2).alias("status"))


def project_status(units: DataFrame) -> DataFrame:
    """One row (pending, failed, status) over units (candidate, analysis_status): busy while candidates are pending, then
    failed if any failed, else ready."""
    c = F.col("candidate")
    g = units.agg(F.count_if(c & F.col("analysis_status").isin(1, 2)).alias("pending"), F.count_if(c & (F.col("analysis_status") == 4)).alias("failed"))
    return g.withColumn("status", F.when(F.col("pending") > 0, 1).when(F.col("failed") > 0, 2).otherwise(0))


def distinct_by_value(df: DataFrame, key: list[str]) -> DataFrame:
    """One row for each value of the key columns."""
    return df.select(*key).distinct()


def timers(samples: DataFrame) -> DataFrame:
    """(label, n, total, mean) of timer samples (label, seconds)."""
    return samples.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"))


def first_last_edges(changes: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Changes (key, order, delta of +1 or -1) that add the first or remove the last instance: with op add or remove."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = changes.withColumn("n", F.sum("delta").over(w))
    op = F.when((F.col("n") == 1) & (F.col("delta") == 1), "add").when((F.col("n") == 0) & (F.col("delta") == -1), "remove")
    return d.withColumn("op", op).where("op is not null")
