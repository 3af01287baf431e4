"""Ordered operators: diagnostics in order, limits, scope stacks, set differences and status changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.kinds import USE
from skein.operators.closure import written


def diagnostic_order(diagnostics: DataFrame) -> DataFrame:
    """diagnostics (severity, unit_order, seq, is_link) with place: from 1 in each severity, by unit and sequence, link
    diagnostics last. Severities don't depend on each other.

    There are three severities, so a window on them would put all rows in three tasks. Rows are sorted over partitions by
    range instead, numbered in each, and moved by the counts of the partitions before.
    """
    order = ["severity", "is_link", "unit_order", "seq"]
    n = int(diagnostics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # written, so that a row's partition is settled
    d = written(diagnostics.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__part", "severity").orderBy(*order))
    counts = d.groupBy("severity", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("severity").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("severity").alias("__s"), F.col("__part").alias("__p"), before.alias("__before"))
    j = d.withColumn("__own", own).join(starts, (F.col("severity") == F.col("__s")) & (F.col("__part") == F.col("__p")))
    return j.select(*[F.col(f"`{c}`") for c in diagnostics.columns], (F.col("__own") + F.col("__before")).cast("int").alias("place"))


def top_diagnostics(diagnostics: DataFrame, order: list, limit: int) -> DataFrame:
    """The first `limit` diagnostics of each severity, with their place.

    row_number with a limit is applied to each partition before the exchange too, so a common severity doesn't gather.
    """
    w = Window.partitionBy("severity").orderBy(*order)
    return diagnostics.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def hidden_diagnostics(diagnostics: DataFrame, limit: int) -> DataFrame:
    """(severity, shown, hidden)."""
    g = diagnostics.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return g.select("severity", F.least("n", F.lit(limit).cast("long")).alias("shown"), F.greatest(F.col("n") - limit, F.lit(0).cast("long")).alias("hidden"))


def limit_tracked(occurrences: DataFrame, key: str, order: list, limit: int, only_uses: bool) -> DataFrame:
    """At most `limit` occurrences of each key in the order (0: all); with only_uses, other kinds than uses don't count
    and always stay."""
    if limit == 0:
        return occurrences
    if not only_uses:
        w = Window.partitionBy(key).orderBy(*order)
        return occurrences.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= limit).drop("__k")
    uses = limit_tracked(occurrences.where(F.col("kind") == USE), key, order, limit, False)
    return occurrences.where(F.col("kind") != USE).unionByName(uses)


def scope_stack(events: DataFrame) -> DataFrame:
    """Open (+1) and close (-1) events (unit_id, seq, d) -> (unit_id, seq, depth, parent_seq, n_inside) of each open one.

    An event that closes what was never opened doesn't count. n_inside: openers until the depth falls below its own.
    """
    # rows are doubled by explode, not by a union of the frame with itself: see the README on unions
    w = Window.partitionBy("unit_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    low = F.least(F.min("run").over(w), F.lit(0))
    e = events.withColumn("seq", F.col("seq").cast("long")).withColumn("run", F.sum("d").over(w)).withColumn("depth", F.col("run") - low)
    opened = F.col("d") == 1
    e = e.withColumn("n_open", F.count_if(opened).over(w))
    # an opener's scope ends at the first later event that closes its depth
    level = F.when(opened, F.col("depth")).otherwise(F.col("depth") + 1)
    after = Window.partitionBy("unit_id", "level").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    e = e.withColumn("level", level).withColumn("end", F.first(F.when(~opened, F.col("seq")), ignorenulls=True).over(after)).where(opened)
    # the parent is the last opener one level up
    rows = e.select("unit_id", "seq", "depth", "n_open", "end", F.explode(F.array(F.struct(F.col("depth").alias("at"), F.lit(True).alias("own")), F.struct((F.col("depth") + 1).alias("at"), F.lit(False).alias("own")))).alias("x"))
    before = Window.partitionBy("unit_id", "x.at").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("parent_seq", F.last(F.when(~F.col("x.own"), F.col("seq")), ignorenulls=True).over(before)).where("x.own")
    # openers up to the end, less those up to the opener itself, are inside
    last = F.coalesce("end", F.lit(2**62))
    spots = rows.select("unit_id", "seq", "depth", "parent_seq", "n_open", F.explode(F.array(F.struct(F.col("seq").alias("at"), F.lit(1).alias("d")), F.struct(last.alias("at"), F.lit(0).alias("d")))).alias("y"))
    count = Window.partitionBy("unit_id").orderBy("y.at", F.desc("y.d")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = spots.withColumn("upto", F.sum("y.d").over(count)).where("y.d = 0")
    return inside.select("unit_id", "seq", "depth", "parent_seq", (F.col("upto") - F.col("n_open")).alias("n_inside"))


def bag_swap(old: DataFrame, new: DataFrame) -> DataFrame:
    """(columns, op): instances to add and to remove, as bags, so that old becomes new."""
    return new.exceptAll(old).withColumn("op", F.lit("add")).unionByName(old.exceptAll(new).withColumn("op", F.lit("remove")))


def set_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(columns, op): rows that are only in one of two sets."""
    keys = old.columns
    gone = old.distinct().join(new.distinct(), keys, "left_anti").withColumn("op", F.lit("remove"))
    return new.distinct().join(old.distinct(), keys, "left_anti").withColumn("op", F.lit("add")).unionByName(gone)


def mask_changes(occurrences: DataFrame, old_mask: int, new_mask: int) -> DataFrame:
    """Occurrences whose membership changes when the tracked kinds change, with op."""
    old, new = F.bit_get(F.lit(old_mask).cast("long"), F.col("kind").cast("int")), F.bit_get(F.lit(new_mask).cast("long"), F.col("kind").cast("int"))
    return occurrences.where(old != new).withColumn("op", F.when(new == 1, "add").otherwise("remove"))


def status_changes(statuses: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows (key, order, status) whose status isn't that of the row before; the first of a key counts."""
    w = Window.partitionBy(key).orderBy(*order)
    return statuses.withColumn("__was", F.lag("status").over(w)).where(~F.col("status").eqNullSafe(F.col("__was")) | F.col("__was").isNull()).drop("__was")
