"""Completion: names that can continue a context at a place of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import insert_position, trailing_identifier
from skein.operators.closure import included_files, written

# Entity kinds that are never offered: section, local static and automatic variables, parameters, fields.
HIDDEN = (12, 15, 17, 18, 21)
EVERYWHERE = 2**32 - 1


def candidates(occurrences: DataFrame) -> DataFrame:
    """Declaring, instantiated occurrences of kinds that completion offers."""
    return occurrences.where((F.col("kind") <= 4) & F.col("instantiated") & ~F.col("entity_kind").isin(*HIDDEN))


def completions(requests: DataFrame, occurrences: DataFrame, includes: DataFrame) -> DataFrame:
    """(request_id, entity_id, name, insert_at) for requests (request_id, file_id, pos, context).

    Offered are names that start with the identifier the context ends with: those declared in the file before pos, and
    all of the files it includes at any depth. Each symbol comes once; two symbols of one name both come.
    """
    r = requests.select("request_id", "file_id", "pos", trailing_identifier(F.col("context")).alias("prefix"), insert_position(F.col("context"), F.col("pos")).alias("insert_at"))
    o = candidates(occurrences).select(F.col("file_id").alias("in_file"), "end", "entity_id", "name")
    reach = included_files(includes, r.select("file_id").distinct()).join(o.select(F.col("in_file").alias("node")).distinct(), "node", "left_semi")
    # files that the same requests reach are one set, whose names are gathered once and not for each request
    reached = written(reach.groupBy("node").agg(F.array_sort(F.collect_set("root")).alias("roots")))
    sets = written(reached.groupBy("roots").agg(F.min("node").alias("set")))
    of = written(reached.join(sets, "roots").select(F.col("node").alias("in_file"), "set"))
    names = o.where(F.col("end") < EVERYWHERE).join(of, "in_file").groupBy("set", "entity_id", "name").agg(F.min("in_file").alias("low"), F.max("in_file").alias("high"))
    asked = written(sets.select("set", F.explode("roots").alias("file_id")).join(r, "file_id"))
    # a name of the set comes from another file than the request's own, where pos counts
    other = names.join(asked, "set").where((F.col("low") != F.col("file_id")) | (F.col("high") != F.col("file_id")))
    own = r.join(o, F.col("file_id") == F.col("in_file")).where(F.col("pos") > F.col("end"))
    out = lambda df: df.where(F.col("name").startswith(F.col("prefix"))).select("request_id", "entity_id", "name", "insert_at")
    return out(other).unionByName(out(own)).distinct()
