"""Tolerant readers for tool output. Each takes lines (stream, seq, line) and gives relations; no process is started.

Sticky headers are `last(.., ignorenulls)` over the rows before; records of several lines use `lead`. Streams are
independent, so windows are partitioned by stream.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.kinds import nm_kind, nm_style


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(stream, seq, line) of text files: the file is the stream; lines are numbered within whole files."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("stream"), "value")
    return files.select("stream", F.posexplode(F.split("value", "\n", -1)).alias("seq", "line")).select("stream", F.col("seq").cast("long").alias("seq"), "line")


def _before() -> Window:
    return Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def sticky(lines: DataFrame, header: Column, name: str) -> DataFrame:
    """lines with `name`: the last header at or before each line (header: null for lines that are none)."""
    return lines.withColumn(name, F.last(header, ignorenulls=True).over(_before()))


def _uneaten(lines: DataFrame, takes: Column) -> DataFrame:
    """lines without those that a statement before them takes; `takes` is how many a line takes if it is a statement.

    A line that is taken itself takes nothing, so what stands where depends on all lines before, up to two in a row that
    can't take any: behind them a run starts anew. A run's digits are cut into statements with their lines by a pattern.
    """
    w = Window.partitionBy("stream").orderBy("seq")
    fresh = (F.coalesce(F.lag("takes", 1).over(w), F.lit(0)) == 0) & (F.coalesce(F.lag("takes", 2).over(w), F.lit(0)) == 0)
    d = lines.withColumn("takes", takes).withColumn("fresh", fresh)
    d = d.withColumn("run", F.count_if("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    digits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "takes"))), lambda x: x["takes"].cast("string")), "")
    # runs of one line, which nearly all are, need no look
    runs = d.where((F.col("takes") > 0) | ~F.col("fresh")).groupBy(F.col("stream").alias("of"), F.col("run").alias("in_run")).agg(digits.alias("digits"), F.array_sort(F.collect_list("seq")).alias("seqs"))
    statements = F.regexp_extract_all("digits", F.lit("0|1[012]?|2[012]{0,2}"), F.lit(0))
    marks = F.split(F.array_join(F.transform(statements, lambda x: F.rpad(F.lit("s"), F.length(x), "t")), ""), "")
    taken = runs.select("of", F.explode(F.arrays_zip(F.col("seqs").alias("at"), marks.alias("mark"))).alias("x")).where("x.mark = 't'").select("of", F.col("x.at").alias("at"))
    return d.join(taken, F.col("stream").eqNullSafe(F.col("of")) & (F.col("seq") == F.col("at")), "left_anti").drop("takes", "fresh", "run")


def event_statements(lines: DataFrame, with_raw: bool = False) -> DataFrame:
    """The line protocol of analysis back ends as (stream, seq, code, file, offset, line, col, name, extra).

    Location: nothing, a byte offset, or line:column. The file is that of the last @ statement. The line after an i
    statement is its include directory, the two after an S statement its regions: they are `extra` and no statements.
    """
    w = Window.partitionBy("stream").orderBy("seq")
    code = F.substring("line", 1, 1)
    d = lines.withColumns({"next1": F.lead("line", 1).over(w), "next2": F.lead("line", 2).over(w)})
    d = _uneaten(d, F.when(code == "i", 1).when(code == "S", 2).otherwise(0)).where(F.length("line") > 0)
    d = sticky(d, F.when(code == "@", F.substring("line", 2, 1_000_000)), "file")
    loc = F.regexp_extract("line", r"^.([0-9]*(?::[0-9]+)?) ", 1)
    offset = F.when(loc.rlike(r"^[0-9]+$"), loc.cast("long"))
    is_pair = loc.contains(":")
    name = F.when(code == "@", F.substring("line", 2, 1_000_000)).otherwise(F.regexp_extract("line", r"^.[0-9:]* (.*)$", 1))
    extra = F.when(code == "i", F.col("next1")).when(code == "S", F.concat_ws("|", "next1", "next2"))
    d = d.withColumn("raw", F.col("line"))
    out = d.select(
        "stream", "seq", F.col("raw"), code.alias("code"), F.nullif("file", F.lit("")).alias("file"), offset.alias("offset"),
        F.when(is_pair, F.split_part(loc, F.lit(":"), F.lit(1)).cast("long")).alias("line"), F.when(is_pair, F.split_part(loc, F.lit(":"), F.lit(2)).cast("long")).alias("col"), name.alias("name"), extra.alias("extra"),
    )
    return out if with_raw else out.drop("raw")


def run_succeeded(exit_code: Column) -> Column:
    """Whether an assembler run's output counts: it may end with 1, when it has reported errors."""
    return exit_code.isin(0, 1)


def memory_regions(statements: DataFrame) -> DataFrame:
    """(stream, name, origin, size) of L statements: L<origin> <size> <name>, decimal numbers."""
    d = statements.where("code = 'L'").select("stream", "raw")
    g = lambda i: F.regexp_extract("raw", r"^L([0-9]+) ([0-9]+) (.*)$", i)
    return d.where(F.col("raw").rlike(r"^L[0-9]+ [0-9]+ .")).select("stream", g(3).alias("name"), g(1).cast("long").alias("origin"), g(2).cast("long").alias("size"))


def memory_sections(statements: DataFrame) -> DataFrame:
    """(stream, name, runtime_region, load_region) of S statements, whose two regions stand on the next lines."""
    two = lambda i: F.split_part("extra", F.lit("|"), F.lit(i))
    return statements.where("code = 'S'").select("stream", "name", two(1).alias("runtime_region"), two(2).alias("load_region"))


# How messages begin that a linker script scan leaves out, as the link step finds those names itself.
LEFT_OUT = "undefined symbol: "


def script_diagnostics(statements: DataFrame) -> DataFrame:
    """(stream, file, offset, line, col, message) of E statements, without those about undefined symbols."""
    return statements.where((F.col("code") == "E") & ~F.col("name").startswith(LEFT_OUT)).select("stream", "file", "offset", "line", "col", F.col("name").alias("message"))


def asm_linkage(statements: DataFrame) -> DataFrame:
    """(stream, name, is_global, linkage, entity): declarations of all statements about a name taken together.

    A symbol is global unless it is local, or defined without being strong, common or weak. Of the linkages local comes
    before weak, weak before common, common before strong. Both or neither of function and variable make it a symbol.
    """
    any_of = lambda *c: F.bool_or(F.col("code").isin(*c))
    g = statements.where(F.col("code").isin(*"uFDfdlwcgae")).groupBy("stream", "name").agg(
        any_of("l").alias("local"), any_of("w").alias("weak"), any_of("c").alias("common"), any_of("g").alias("strong"), any_of("F", "D", "a").alias("defined"), any_of("F", "f").alias("fun"), any_of("D", "d").alias("var")
    )
    linkage = F.when(F.col("local"), "local").when(F.col("weak"), "weak").when(F.col("common"), "common").otherwise("strong")
    is_global = ~F.col("local") & (~F.col("defined") | F.col("strong") | F.col("common") | F.col("weak"))
    entity = F.when(F.col("fun") & ~F.col("var"), 3).when(F.col("var") & ~F.col("fun"), 2).otherwise(1)
    return g.select("stream", "name", is_global.alias("is_global"), linkage.alias("linkage"), entity.alias("entity"))


def redefinition_segments(statements: DataFrame) -> DataFrame:
    """statements with `segment`: a set statement (a) of a name that is defined already opens the name's next segment."""
    w = Window.partitionBy("stream", "name").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sets = F.count_if(F.col("code") == "a").over(w)
    return statements.withColumn("segment", F.greatest(sets - 1, F.lit(0)).cast("long"))


def nm_symbols(lines: DataFrame) -> DataFrame:
    """Symbol listings of objects and archives: (stream, seq, member, letter, name, kind, style); other letters go."""
    d = sticky(lines, F.when(F.col("line").rlike(r"^\S.*:$"), F.regexp_extract("line", r"^(.*):$", 1)), "member")
    pat = r"^(?:[0-9a-fA-F]+)?\s+(?:[0-9a-fA-F]+\s+)?([A-Za-z]) (\S.*)$"
    d = d.where(F.col("line").rlike(pat)).withColumns({"letter": F.regexp_extract("line", pat, 1), "name": F.regexp_extract("line", pat, 2)})
    d = d.withColumns({"kind": nm_kind(F.col("letter")), "style": nm_style(F.col("letter"))})
    return d.where("kind is not null").select("stream", "seq", "member", "letter", "name", "kind", "style")


def asm_diagnostics(lines: DataFrame) -> DataFrame:
    """path:line:col: warning|error: message -> (stream, seq, path, line, col, severity, message, relevant), from zero.

    relevant: whether the error can change which global symbols the unit defines.
    """
    pat = r"^(.+):([0-9]+):([0-9]+): (warning|error): (.*)$"
    g = lambda i: F.regexp_extract("line", pat, i)
    d = lines.where(F.col("line").rlike(pat)).select("stream", "seq", g(1).alias("path"), (g(2).cast("long") - 1).alias("line"), (g(3).cast("long") - 1).alias("col"), F.when(g(4) == "error", 1).otherwise(0).alias("severity"), g(5).alias("message"))
    return d.withColumn("relevant", linker_relevant(F.col("severity"), F.col("message")))


# Errors that leave the global symbols as they are.
SAFE_ERRORS = r"^(invalid instruction.*|too few operands for instruction.*|unexpected token in operand.*|unexpected token in argument list.*)$"


def linker_relevant(severity: Column, message: Column) -> Column:
    return (severity >= 1) & ~message.rlike(SAFE_ERRORS)


def make_errors(lines: DataFrame, files: DataFrame) -> DataFrame:
    """[make[n]: ]path:line: message of a make run, for paths that are files: (stream, seq, path, line, message)."""
    bare = F.regexp_replace("line", r"^make\[[^ ]* ", "")
    pat = r"^([^:]+):([0-9]+): (.*?)(?:  Stop\.)?$"
    d = lines.withColumn("bare", bare).where(~F.col("bare").startswith("warning: ") & ~F.col("bare").startswith("*** No rule to make target '"))
    d = d.where(F.col("bare").rlike(pat)).select("stream", "seq", F.regexp_extract("bare", pat, 1).alias("path"), (F.regexp_extract("bare", pat, 2).cast("long") - 1).alias("line"), F.regexp_extract("bare", pat, 3).alias("message"))
    return d.join(files.select("path").distinct(), "path", "left_semi").select("stream", "seq", "path", "line", "message")


def builtin_macros(lines: DataFrame) -> DataFrame:
    """#define lines of a compiler's own macros: (stream, seq, header, value)."""
    pat = r"^#define (\S+(?:\([^)]*\))?) ?(.*)$"
    return lines.where(F.col("line").rlike(pat)).select("stream", "seq", F.regexp_extract("line", pat, 1).alias("header"), F.regexp_extract("line", pat, 2).alias("value"))


def include_dirs(lines: DataFrame) -> DataFrame:
    """Directories between a compiler's '#include <...> search starts here:' and 'End of search list.' lines."""
    on = F.when(F.col("line").startswith("#include ") & F.col("line").endswith("search starts here:"), True).when(F.col("line").startswith("End of search list"), False)
    d = sticky(lines, on, "inside")
    return d.where(F.col("inside") & F.col("line").startswith(" ")).select("stream", "seq", F.trim("line").alias("dir"))


def make_database(lines: DataFrame) -> DataFrame:
    """(stream, seq, section, target, prerequisite) of the rules in a make database, by the section they stand in."""
    d = sticky(lines, F.when(F.col("line").rlike(r"^# (Files|Implicit Rules|Variables|Directories)$"), F.substring("line", 3, 100)), "section")
    pat = r"^([^\s#:=][^:=]*?)\s*:(?!=)\s*(.*)$"
    d = d.where(F.col("line").rlike(pat))
    rules = d.select("stream", "seq", "section", F.regexp_extract("line", pat, 1).alias("target"), F.explode_outer(F.filter(F.split(F.regexp_extract("line", pat, 2), r"\s+"), lambda x: x != "")).alias("prerequisite"))
    return rules


# What a compiler is called.
COMPILER = r"^(?:.*/)?(?:[^/]*-)?(?:gcc|g\+\+)$"


def compiler_commands(lines: DataFrame) -> DataFrame:
    """Words after the first compiler of each line of a dry run: (stream, seq, compiler, words)."""
    from skein.functions.text import command_words

    d = lines.withColumn("all", command_words(F.col("line")))
    at = F.array_position(F.transform("all", lambda x: x.rlike(COMPILER)), True)
    d = d.withColumn("at", at.cast("int")).where("at > 0")
    return d.select("stream", "seq", F.element_at("all", F.col("at")).alias("compiler"), F.slice("all", F.col("at") + 1, F.greatest(F.size("all") - F.col("at"), F.lit(0))).alias("words"))


def link_command_items(commands: DataFrame) -> DataFrame:
    """Words (stream, pos, word) of a link command -> ordered items (stream, pos, item, value).

    item: file, library, path, defsym, group-open, group-close or gc-sections; values may be in the next word.
    """
    w = Window.partitionBy("stream").orderBy("pos")
    d = commands.withColumns({"next": F.lead("word").over(w), "prev": F.lag("word").over(w)})
    taken = F.coalesce(F.col("prev").isin("-L", "-l", "--defsym", "-o", "-T"), F.lit(False))
    word = F.col("word")
    item = (
        F.when(taken, None)
        .when(word.isin("-(", "--start-group"), "group-open")
        .when(word.isin("-)", "--end-group"), "group-close")
        .when(word == "--gc-sections", "gc-sections")
        .when(word.startswith("--defsym"), "defsym")
        .when(word.startswith("-L"), "path")
        .when(word.startswith("-l"), "library")
        .when(~word.startswith("-"), "file")
    )
    value = (
        F.when(item == "defsym", F.regexp_extract(F.when(word == "--defsym", F.col("next")).otherwise(F.substring(word, F.lit(10), F.length(word))), r"^([^=]*)", 1))
        .when(item.isin("path", "library"), F.when(F.length(word) == 2, F.col("next")).otherwise(F.substring(word, F.lit(3), F.length(word))))
        .when(item == "file", word)
    )
    return d.withColumns({"item": item, "value": value}).where("item is not null").select("stream", "pos", "item", "value")


def write_cache(results: DataFrame, path: str) -> None:
    """Analysis results appended to a cache as its newest generation; those of other units stay as they are.

    results needs unit_id. Buckets, not units, are folders, so their number doesn't grow with the code; writers that run
    at once write generations of their own.
    """
    stamped = results.withColumns({"generation": F.lit(time.time_ns()), "bucket": F.pmod("unit_id", F.lit(64)).cast("int")})
    stamped.write.mode("append").partitionBy("bucket", "generation").parquet(path)


def cached_results(spark: SparkSession, path: str) -> DataFrame:
    """Each unit's results of the newest generation that has it."""
    every = spark.read.parquet(path)
    newest = every.groupBy(F.col("unit_id").alias("of")).agg(F.max("generation").alias("newest"))
    return every.join(newest, F.col("unit_id").eqNullSafe(F.col("of")) & (F.col("generation") == F.col("newest")), "left_semi").drop("generation", "bucket")


def read_cache(cached: DataFrame, signatures: DataFrame, flags: DataFrame) -> DataFrame:
    """(unit_id, valid): a unit's cache is valid if its flags are those of `flags` and every file's signature still is
    that of `signatures`. cached: (unit_id, file_id, signature, flags)."""
    now = signatures.withColumnRenamed("signature", "now")
    want = flags.select("unit_id", F.col("flags").alias("want"))
    j = cached.join(now, "file_id", "left").join(want, "unit_id", "left")
    same = F.col("signature").eqNullSafe(F.col("now")) & F.col("flags").eqNullSafe(F.col("want"))
    return j.groupBy("unit_id").agg(F.bool_and(same).alias("valid"))
