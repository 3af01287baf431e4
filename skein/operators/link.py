"""Link resolution: which sections get linked, the status of every name, and the diagnostics that follow.

Within one step all definitions of the chosen tier are linked, so the order of names doesn't matter: stratum 1 is the
closure from the roots over strong definitions, stratum 2 the closure over the best tier of each name still open.
Archives come in command order, a group again and again until nothing new is linked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.closure import reachable, written
from skein.operators.counters import link_status


def requirements(section_occ: DataFrame, explicit: DataFrame) -> DataFrame:
    """(section_id, name, weak) from uses that are not virtual (kind 5, or 6 for weak) and explicit requirements; a name
    that a section requires both ways is required strongly."""
    uses = section_occ.where(F.col("kind").isin(5, 6) & (F.col("style") != 3)).select("section_id", "name", (F.col("kind") == 6).alias("weak"))
    both = uses.unionByName(explicit.select("section_id", "name", "weak"))
    return both.groupBy("section_id", "name").agg(F.bool_and("weak").alias("weak"))


def definition_sections(defs: DataFrame, section_occ: DataFrame, sections: DataFrame, files: DataFrame) -> DataFrame:
    """(name, section_id, tier): the sections that a definition can be linked from.

    defs: (name, occ_id, tier); section_occ: (section_id, occ_id), the occurrences that a section instantiates, in its own
    file or in any it includes; sections: (section_id, file_id), the file being the unit that was compiled; files:
    (file_id, allowed), whether the file may be linked in this step. A header's definition thus comes from the sections of
    the units that include it, at whatever depth: the include closure is in section_occ, so none is walked here, and
    headers that include each other do no harm.
    """
    open_ = sections.join(files.where("allowed").select("file_id").distinct(), "file_id", "left_semi").select("section_id")
    # what is looked up in is hashed and repeats go last, so a task sorts and gathers no occurrences before
    held = section_occ.select("section_id", "occ_id").join(open_.hint("shuffle_hash"), "section_id", "left_semi")
    return held.join(defs.hint("shuffle_hash"), "occ_id").select("name", "section_id", "tier").distinct()


def roots(script_uses: DataFrame, forced_definitions: DataFrame, gc_sections: bool) -> DataFrame:
    """(name): main, global symbols that linker scripts use and, unless sections are collected, the definitions of all
    sections in forced files and in files of the command that are no archives."""
    spark = script_uses.sparkSession
    out = script_uses.select("name").union(spark.createDataFrame([("main",)], "name string"))
    return (out if gc_sections else out.union(forced_definitions.select("name"))).distinct()


def _open(edges: DataFrame, resolved: DataFrame) -> DataFrame:
    """(src, dst) of edges whose dst is not resolved yet."""
    return edges.select("src", "dst").join(resolved.select(F.col("name").alias("dst")).distinct(), "dst", "left_anti").select("src", "dst")


def _reached(names: DataFrame, edges: DataFrame) -> DataFrame:
    seeds = names.select(F.lit(0).alias("root"), F.col("name").alias("node"))
    return reachable(edges, seeds).select(F.col("node").alias("name"))


def link_step(names: DataFrame, defs: DataFrame, reqs: DataFrame, linked: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both strata of one step: (linked sections, resolved names, names left open). defs: (name, section_id, tier) of
    allowed sections; names: open ones; resolved: names that were required before, which are not required again."""
    names = names.select("name").distinct()
    strong = defs.where("tier = 0")
    best = defs.groupBy("name").agg(F.min("tier").alias("best"))
    tier = written(defs.join(best, "name").where("tier = best").select("name", "section_id", "tier"))
    # a name's sections of its best tier require dst; strong ones are among them, so requirements are joined once
    edges = written(tier.join(reqs.select("section_id", F.col("name").alias("dst")), "section_id").select(F.col("name").alias("src"), "dst", "tier").distinct())
    known = resolved.select("name").union(names).distinct()
    first = _reached(names, _open(edges.where("tier = 0"), known))
    linked = written(linked.union(strong.join(first, "name", "left_semi").select("section_id")).distinct())
    known = written(known.union(first).distinct())
    # names that a linked section defines in whatever tier are not looked up again
    have = defs.join(linked, "section_id", "left_semi").select("name").distinct()
    again = written(first.join(have, "name", "left_anti"))
    second = _reached(again, _open(edges, known))
    linked = written(linked.union(tier.join(second, "name", "left_semi").select("section_id")).distinct())
    return linked, written(known.union(second).distinct()), written(second.join(tier.select("name").distinct(), "name", "left_anti"))


def link(root_names: DataFrame, defs: DataFrame, reqs: DataFrame, archives: list[list[DataFrame]] | None = None) -> DataFrame:
    """(section_id) of all linked sections.

    defs: (name, section_id, tier: 0 strong, 1 tentative, 2 weak) of sections outside archives; reqs: (section_id, name,
    weak). archives: the steps in command order; a step is a list of such definition tables, and a step of several (a
    group) is repeated until it links nothing new.
    """
    names = root_names.select("name").distinct()
    linked = names.sparkSession.createDataFrame([], f"section_id {reqs.schema['section_id'].dataType.simpleString()}")
    linked, resolved, left = link_step(names, defs, reqs, linked, written(names))
    every = defs
    for step in archives or []:
        for d in step:
            every = every.unionByName(d)
        while True:
            before = linked.count()
            for d in step:
                # what is defined already is not resolved from later archives
                defined = linked.join(every.where("tier = 0"), "section_id").select("name").distinct()
                want = written(left.join(defined, "name", "left_anti"))
                if want.join(d.select("name"), "name", "left_semi").isEmpty():
                    continue  # nothing in this archive is asked for
                linked, resolved, left = link_step(want, defs.unionByName(d), reqs, linked, resolved)
            if len(step) == 1 or linked.count() == before:
                break
    return linked


def link_facts(linked: DataFrame, definitions: DataFrame, reqs: DataFrame, root_names: DataFrame, builtins: DataFrame | None = None, script: DataFrame | None = None) -> DataFrame:
    """(name, fact, n) for link_status: definitions count per instance in a linked section; script: (name, fact)."""
    tiers = F.array(*[F.lit(x) for x in ("strong", "tentative", "weak")])
    d = definitions.join(linked, "section_id", "left_semi").select("name", F.get(tiers, F.col("tier")).alias("fact"))
    r = reqs.join(linked, "section_id", "left_semi").select("name", F.when(F.col("weak"), "weakly_required").otherwise("required").alias("fact"))
    out = d.unionByName(r).unionByName(root_names.select("name", F.lit("required").alias("fact")))
    if builtins is not None:
        out = out.unionByName(builtins.select("name", F.lit("builtin").alias("fact")))
    if script is not None:
        out = out.unionByName(script.select("name", "fact"))
    return out.groupBy("name", "fact").agg(F.count(F.lit(1)).alias("n"))


def adjusted(status: DataFrame, defsyms: DataFrame) -> DataFrame:
    """Statuses after the defsyms: a name left undefined that is one is weakly defined."""
    j = status.join(defsyms.select("name", F.lit(True).alias("rescued")).distinct(), "name", "left")
    return j.select("name", F.when(F.col("rescued") & (F.col("status") == 2), 3).otherwise(F.col("status")).alias("status"))


def link_diagnostics(status: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(file_id, begin, message) of link errors. occurrences: (name, kind, effective_kind, file_id, begin, linked).

    An undefined name gives an error at each linked use, and at linked definitions and declarations too if it is a
    virtual function; a multiply defined name at each linked strong definition; an undefined main one without a place.
    """
    j = occurrences.where("linked").join(status.where("status in (2, 6)"), "name")
    undefined = (F.col("status") == 2) & ((F.col("kind") == 5) | ((F.col("effective_kind") == 4) & (F.col("kind") <= 4)))
    multiple = (F.col("status") == 6) & (F.col("kind") == 0)
    text = F.when(undefined, F.concat(F.lit("undefined global symbol "), "name")).when(multiple, F.concat(F.lit("multiply defined global symbol "), "name"))
    at = j.select("file_id", "begin", text.alias("message")).where("message is not null")
    main = status.where((F.col("name").cast("string") == "main") & (F.col("status") == 2)).select(F.lit(None).cast(occurrences.schema["file_id"].dataType).alias("file_id"), F.lit(None).cast(occurrences.schema["begin"].dataType).alias("begin"), F.lit("Undefined function 'main'").alias("message"))
    return at.unionByName(main)


def statuses(linked: DataFrame, definitions: DataFrame, reqs: DataFrame, root_names: DataFrame) -> DataFrame:
    return link_status(link_facts(linked, definitions, reqs, root_names))
