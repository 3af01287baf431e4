"""Lookups and joins over files, occurrences and commands. Every range join has an equality on the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.kinds import USE, in_mask
from skein.functions.text import pattern_fill, pattern_stem


def files_by_path(paths: DataFrame, key: Column) -> DataFrame:
    """A file for each distinct key: (key, file_id = smallest id, path). Registering twice gives the same file."""
    return paths.withColumn("key", key).groupBy("key").agg(F.min("file_id").alias("file_id"), F.min_by("path", "file_id").alias("path"))


def add_files(files: DataFrame, added: DataFrame, missing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the added ones' modes in place, units (unit_id, header, path) to wake because a header came)."""
    new = added.select("file_id", "path", "mode")
    kept = files.select("file_id", "path", "mode").join(new.select("file_id"), "file_id", "left_anti")
    return kept.unionByName(new), missing_header_matches(missing, new)


def remove_files(files: DataFrame, removed: DataFrame, includes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files with the removed ones' mode set to exclude, file_id of all their transitive includers, to load again)."""
    from skein.operators.closure import reload_set

    gone = removed.select("file_id").distinct().withColumn("gone", F.lit(True))
    j = files.join(gone, "file_id", "left")
    out = j.select("file_id", "path", F.when(F.col("gone"), 0).otherwise(F.col("mode")).alias("mode"))
    return out, reload_set(includes, removed)


def symbols_by_name(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """Symbols with one of the names (link_name), each name once."""
    return symbols.join(names.select("link_name").distinct(), "link_name", "left_semi")


def _bucketed(df: DataFrame, begin: Column, end: Column, width: int) -> DataFrame:
    """df with a row for each block of `width` bytes its range touches: the equality that turns a range join into a hash join."""
    # the rows grow with the range's length over width alone
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(begin / width), F.floor((F.greatest(end, begin + 1) - 1) / width))))


def occurrence_at(occurrences: DataFrame, probes: DataFrame, begin_tol: int = 0, end_tol: int = 0, width: int = 4096) -> DataFrame:
    """For probes (probe_id, file_id, offset): the smallest occurrence (.., file_id, begin, end, kind, entity_id) that the
    click window overlaps. Ties go to the higher kind code, then begin, then entity. Probes without a hit have no row.

    A click reaches end_tol bytes to the left, so that the end of a name still hits it, and begin_tol to the right.
    """
    p = _bucketed(_windows(probes, begin_tol, end_tol), F.col("low"), F.col("high"), width)
    o = _bucketed(occurrences.where(F.col("end") > F.col("begin")), F.col("begin"), F.col("end"), width)
    return smallest(p.join(o, ["file_id", "bucket"]).drop("bucket"))


def _windows(probes: DataFrame, begin_tol: int, end_tol: int) -> DataFrame:
    return probes.withColumns({"low": F.greatest(F.col("offset") - end_tol, F.lit(0)), "high": F.col("offset") + begin_tol + 1})


def smallest(near: DataFrame) -> DataFrame:
    """For probes with an occurrence each (probe_id, file_id, offset, low, high, begin, end, kind, entity_id): the smallest
    that overlaps the click window, as in occurrence_at."""
    hit = near.where((F.col("end") > F.col("begin")) & (F.col("begin") < F.col("high")) & (F.col("low") < F.col("end")))
    size = F.col("end") - F.col("begin")
    w = Window.partitionBy("probe_id").orderBy(size, F.desc("kind"), "begin", "entity_id")
    return hit.withColumn("rank", F.row_number().over(w)).where("rank = 1").select("probe_id", "file_id", "offset", "begin", "end", "kind", "entity_id")


def chunks_at(chunks: DataFrame, probes: DataFrame, begin_tol: int = 0, end_tol: int = 0, width: int = 4096) -> DataFrame:
    """Probes (probe_id, file_id, offset) with each chunk (file_id, begin, end, ..) that the click window overlaps, each
    pair once, and low and high. All occurrences that a click hits lie in such chunks: only texts move, not occurrences."""
    p = _bucketed(_windows(probes, begin_tol, end_tol), F.col("low"), F.col("high"), width)
    k = _bucketed(chunks, F.col("begin"), F.col("end"), width)
    # the probes are hashed, so texts needn't be sorted; of the blocks that both touch the first counts
    j = k.join(p.hint("shuffle_hash"), ["file_id", "bucket"]).where((F.col("begin") < F.col("high")) & (F.col("low") < F.col("end")))
    return j.where(F.floor(F.greatest("begin", "low") / width) == F.col("bucket")).drop("bucket")


def range_at(ranges: DataFrame, probes: DataFrame, width: int = 4096) -> DataFrame:
    """For probes (probe_id, file_id, offset): begin and end of the smallest range that contains the offset, then the
    first; (0, 0) if there is none."""
    r = _bucketed(ranges.where(F.col("end") > F.col("begin")), F.col("begin"), F.col("end"), width)
    p = probes.withColumn("bucket", F.floor(F.col("offset") / width))
    j = p.join(r, ["file_id", "bucket"], "left")
    inside = (F.col("begin") <= F.col("offset")) & (F.col("offset") < F.col("end"))
    best = F.min(F.when(inside, F.struct((F.col("end") - F.col("begin")).alias("size"), F.col("begin").alias("begin"), F.col("end").alias("end"))))
    return j.groupBy("probe_id", "file_id", "offset").agg(best.alias("b")).select("probe_id", "file_id", "offset", F.coalesce("b.begin", F.lit(0)).cast("long").alias("begin"), F.coalesce("b.end", F.lit(0)).cast("long").alias("end"))


def occurrences_of(occurrences: DataFrame, entities: DataFrame, mask: int = 0xFF) -> DataFrame:
    """Occurrences of the entities with a kind in the mask; `list` is uses for plain uses and defs for all others."""
    j = occurrences.join(entities.select("entity_id").distinct(), "entity_id", "left_semi").where(in_mask(mask, F.col("kind")))
    return j.withColumn("list", F.when(F.col("kind") == USE, "uses").otherwise("defs"))


def occurrences_in(occurrences: DataFrame, files: DataFrame, occurrence_mask: int = 0xFF, entity_mask: int = (1 << 26) - 1) -> DataFrame:
    """Occurrences in the files whose kind and entity_kind are in the masks."""
    j = occurrences.join(files.select("file_id").distinct(), "file_id", "left_semi")
    return j.where(in_mask(occurrence_mask, F.col("kind")) & in_mask(entity_mask, F.col("entity_kind")))


def includers(includes: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, includer) for include edges (includer, included)."""
    return includes.join(files.select(F.col("file_id").alias("included")).distinct(), "included", "left_semi").select(F.col("included").alias("file_id"), "includer").distinct()


def rule_targets(sources: DataFrame, rules: DataFrame) -> DataFrame:
    """(file_id, path, target, stem): targets of the rules (rule_id, target, prerequisite) that fit a source path.

    Of the rules that give one target the one with the shortest stem counts, then the first. Rules are joined on the
    suffix after %, cut to the extension, so the join has an equality; their number is that of a makefile.
    """
    ext = lambda c: F.regexp_extract(c, r"(\.[^./%]*)$", 1)
    r = rules.withColumn("ext", ext(F.col("prerequisite")))
    j = sources.withColumn("ext", ext(F.col("path"))).join(r, "ext").withColumn("stem", pattern_stem(F.col("prerequisite"), F.col("path"))).where("stem is not null")
    j = j.withColumn("to", pattern_fill(F.col("target"), F.col("stem")))
    w = Window.partitionBy("file_id", "to").orderBy(F.length("stem"), "rule_id")
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").select("file_id", "path", F.col("to").alias("target"), "stem")


def choose_target(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """(file_id, target): a fold over a source's targets in name order. A target replaces the best so far if its stem is
    shorter, or if it is an object file and no object file was chosen yet. Without targets it is path.o."""
    item = F.struct("target", F.length("stem").alias("n"), F.lower(F.regexp_extract("target", r"\.([^./]*)$", 1)).isin("o", "obj").alias("object"))
    g = targets.groupBy("file_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.struct(F.lit(None).cast("string").alias("target"), F.lit(2**31 - 1).alias("n"), F.lit(False).alias("object"))

    def step(best: Column, x: Column) -> Column:
        better = best["target"].isNull() | (x["n"] < best["n"]) | (x["object"] & ~best["object"])
        return F.when(better, x).otherwise(best)

    best = g.select("file_id", F.aggregate("all", start, step)["target"].alias("best"))
    return sources.join(best, "file_id", "left").select("file_id", F.coalesce("best", F.concat("path", F.lit(".o"))).alias("target"))


def missing_header_matches(missing: DataFrame, paths: DataFrame) -> DataFrame:
    """(unit_id, header, path): new paths that end with a missing header at a slash and are longer than it.

    Paths are exploded to their tails, so this is an equi-join; a header's leading ../ are dropped.
    """
    parts = F.split("path", "/", -1)
    tails = paths.select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("tail")).where(F.contains("path", F.lit("/")))
    m = missing.withColumn("tail", F.regexp_replace("header", r"^(\.\./)+", ""))
    return m.join(tails, "tail").select("unit_id", "header", "path").distinct()


def missing_header_in_dirs(missing: DataFrame, dirs: DataFrame, paths: DataFrame) -> DataFrame:
    """(unit_id, header, dir): missing headers that exist below a new include directory."""
    # the path decides the directory: those of its prefixes that are asked for
    parts = F.split("path", "/", -1)
    below = paths.select("path", F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("i")).select("path", F.array_join(F.slice(parts, F.lit(1), F.col("i")), "/").alias("dir"), F.array_join(F.slice(parts, F.col("i") + 1, F.size(parts)), "/").alias("header"))
    return missing.join(below.join(dirs.select("dir").distinct(), "dir", "left_semi"), "header").select("unit_id", "header", "dir").distinct()


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """(keys, op, old values, new values): added, removed and changed rows; equal ones have no row."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("in_old"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("in_new"))
    j = o.join(n, keys, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}"))
    op = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~same, "changed")
    return j.withColumn("op", op).where("op is not null").drop("in_old", "in_new")


def resolve_libraries(libraries: DataFrame, dirs: DataFrame, paths: DataFrame) -> DataFrame:
    """(pos, name, path): lib<name>.a in the first directory of the search order (dir, dir_pos) that holds it; null for
    libraries that no directory holds. The order of pos is the command's."""
    there = paths.select("path", F.regexp_extract("path", r"^(.*)/", 1).alias("dir"), F.regexp_extract("path", r"/lib([^/]*)\.a$", 1).alias("name")).where("name <> ''")
    best = there.join(dirs, "dir").groupBy("name").agg(F.min_by("path", "dir_pos").alias("path"))
    return libraries.join(best, "name", "left").select("pos", "name", "path")


def instantiated_by(occurrences: DataFrame, section_occ: DataFrame) -> DataFrame:
    """Occurrences that some section holds."""
    return occurrences.join(section_occ.select("occ_id").distinct(), "occ_id", "left_semi")


def orphans(names: DataFrame, link_map: DataFrame) -> DataFrame:
    """Names that the link map no longer has; their status falls back to none (0)."""
    return names.join(link_map.select("name").distinct(), "name", "left_anti").withColumn("status", F.lit(0))


def flags_for_units(units: DataFrame, flags: DataFrame, make_failed: DataFrame) -> DataFrame:
    """(unit_id, path, flags, diagnostic): a unit without flags gets a fatal diagnostic, unless make has failed anyhow.

    make_failed has a row if it did; it is one row at most, and so is the broadcast.
    """
    failed = make_failed.limit(1).select(F.lit(True).alias("failed"))
    j = units.join(flags, "unit_id", "left").join(F.broadcast(failed), F.lit(True), "left")
    text = F.when(F.col("flags").isNull() & F.col("failed").isNull(), F.concat(F.lit("Don't know how to compile "), "path"))
    return j.select("unit_id", "path", "flags", text.alias("diagnostic"))


def scopes_of(spans: DataFrame) -> DataFrame:
    """(unit_id, seq, parent_seq) for pre-order spans (unit_id, seq, count): the nearest span before that still covers
    seq, null at the top. Found by depth: the last opener one level up."""
    # rows are doubled by explode, not by a union of the frame with itself: see the README on unions
    edge = lambda at, d: F.struct(at.cast("long").alias("at"), F.lit(d).alias("d"))
    both = spans.select("unit_id", F.col("seq").cast("long").alias("seq"), F.explode(F.array(edge(F.col("seq"), 1), edge(F.col("seq") + F.col("count") + 1, -1))).alias("x"))
    w = Window.partitionBy("unit_id").orderBy("x.at", "x.d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    e = both.withColumn("depth", F.sum("x.d").over(w)).where("x.d = 1")
    # at one depth spans follow each other, so the parent is the last of the level above
    level = lambda at, own: F.struct(at.alias("at"), F.lit(own).alias("own"))
    up = e.select("unit_id", "seq", F.explode(F.array(level(F.col("depth"), True), level(F.col("depth") + 1, False))).alias("y"))
    w2 = Window.partitionBy("unit_id", "y.at").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return up.withColumn("parent_seq", F.last(F.when(~F.col("y.own"), F.col("seq")), ignorenulls=True).over(w2)).where("y.own").select("unit_id", "seq", "parent_seq")
