"""Byte positions: ranges, line tables and edit logs. A range is half open; offsets are bytes, from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_empty(begin: Column, end: Column) -> Column:
    return end <= begin


def is_void(begin: Column, end: Column) -> Column:
    return end < begin


def overlaps(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """False if either range is empty."""
    return (F.greatest(b1, b2) < F.least(e1, e2)) & (b1 < e1) & (b2 < e2)


def contains(begin: Column, end: Column, offset: Column) -> Column:
    return (begin <= offset) & (offset < end)


def includes(b1: Column, e1: Column, b2: Column, e2: Column) -> Column:
    """Whether the first range holds all of the second."""
    return (b1 <= b2) & (e2 <= e1)


def word_chunks(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(file_id, seq, begin, end, text): a file's words, which end at a space or a line's end, in runs of about the square
    root of their number; seq and begin are those of the first word, text has the words with a space between them.

    Made within a file's row: no window, no exchange, and each running sum is as long as a root.
    """
    f = files.select(F.col(id_col).alias("file_id"), F.split(text_col, "[ \n]", -1).alias("words"))
    f = f.withColumn("step", F.ceil(F.sqrt(F.size("words"))).cast("int"))
    f = f.withColumn("runs", F.transform(F.sequence(F.lit(1), F.size("words"), F.col("step")), lambda i: F.array_join(F.slice("words", i, F.col("step")), " ")))
    at = F.aggregate("runs", F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x) + 1)))
    f = f.select("file_id", "step", "runs", at.alias("at")).select("file_id", "step", F.posexplode(F.arrays_zip("runs", "at")).alias("i", "x")).where("x.runs is not null")
    return f.select("file_id", (F.col("i") * F.col("step")).alias("seq"), F.col("x.at").alias("begin"), (F.col("x.at") + F.octet_length("x.runs")).alias("end"), F.col("x.runs").alias("text"))


def chunk_words(chunks: DataFrame) -> DataFrame:
    """(file_id, seq, word, n, begin): the words of chunks, n bytes each; file_id may be any key."""
    f = chunks.select("file_id", "seq", "begin", F.split("text", " ", -1).alias("words"))
    at = F.aggregate("words", F.array("begin"), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.octet_length(x) + 1)))
    f = f.select("file_id", "seq", F.posexplode(F.arrays_zip("words", at.alias("at"))).alias("i", "x")).where("x.words is not null")
    return f.select("file_id", (F.col("seq") + F.col("i")).alias("seq"), F.col("x.words").alias("word"), F.octet_length("x.words").alias("n"), F.col("x.at").alias("begin"))


def line_table(files: DataFrame, id_col: str = "file_id", text_col: str = "text") -> DataFrame:
    """(file_id, line, begin, len): zero-based lines with byte offsets; len counts the line end, the last line's too.

    One window a file, over lines, not bytes.
    """
    lines = files.select(F.col(id_col).alias("file_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "s"))
    size = lines.select("file_id", F.col("line").cast("long").alias("line"), (F.octet_length("s") + 1).cast("long").alias("len"))
    w = Window.partitionBy("file_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return size.withColumn("begin", F.coalesce(F.sum("len").over(w), F.lit(0)).cast("long")).select("file_id", "line", "begin", "len")


def offset_of(lines: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (probe_id, file_id, line, col) with offset: begin + col, 0 where the line or column is out of range.

    A column is in range up to the line's length without its line end.
    """
    j = probes.join(lines, ["file_id", "line"], "left")
    ok = F.coalesce((F.col("col") >= 0) & (F.col("col") < F.col("len")), F.lit(False))
    return j.select("probe_id", "file_id", "line", "col", F.when(ok, F.col("begin") + F.col("col")).otherwise(0).cast("long").alias("offset"))


def clamped_offset_of(lines: DataFrame, probes: DataFrame) -> DataFrame:
    """Like offset_of, but a line beyond the last gives the end of the file and the column isn't checked."""
    end = lines.groupBy("file_id").agg(F.max(F.col("begin") + F.col("len")).alias("end"))
    j = probes.join(lines, ["file_id", "line"], "left").join(end, "file_id", "left")
    return j.select("probe_id", "file_id", "line", "col", F.coalesce(F.col("begin") + F.col("col"), F.col("end"), F.lit(0)).cast("long").alias("offset"))


LOG = "array<struct<offset:bigint,remove:bigint,insert:bigint>>"


def merged_log(edits: Column) -> Column:
    """Edits in order -> the log. What an edit removes and what the last entry inserted are spans of one text; where they
    touch, both become one entry that inserts their union, less what the edit removed and more what it inserted."""

    def step(log: Column, e: Column) -> Column:
        last = F.get(log, F.size(log) - 1)
        low = F.least(last["offset"], e["offset"])
        union = F.greatest(last["offset"] + last["insert"], e["offset"] + e["remove"]) - low
        one = F.struct(low.cast("long").alias("offset"), (last["remove"] + union - last["insert"]).cast("long").alias("remove"), (union - e["remove"] + e["insert"]).cast("long").alias("insert"))
        two = F.struct(*[e[k].cast("long").alias(k) for k in ("offset", "remove", "insert")])
        # spans touch if their union is no longer than both together
        touch = (F.size(log) > 0) & (union <= last["insert"] + e["remove"])
        return F.when(touch, F.concat(F.slice(log, 1, F.greatest(F.size(log) - 1, F.lit(0))), F.array(one))).otherwise(F.concat(log, F.array(two)))

    return F.aggregate(edits, F.array().cast(LOG), step)


def apply_offset(log: Column, offset: Column) -> Column:
    """A position before the edits -> after them; a position in removed text becomes the place of the edit."""

    def step(at: Column, e: Column) -> Column:
        moved = F.when(at < e["offset"] + e["remove"], e["offset"]).otherwise(at - e["remove"] + e["insert"])
        return F.when(at >= e["offset"], moved).otherwise(at).cast("long")

    return F.aggregate(log, offset.cast("long"), step)


def revert_offset(log: Column, offset: Column) -> Column:
    """A position after the edits -> before them."""

    def step(at: Column, e: Column) -> Column:
        moved = F.when(at < e["offset"] + e["insert"], e["offset"]).otherwise(at - e["insert"] + e["remove"])
        return F.when(e["offset"] <= at, moved).otherwise(at).cast("long")

    return F.aggregate(F.reverse(log), offset.cast("long"), step)


def _move_range(log: Column, begin: Column, end: Column, gone: str, come: str) -> Column:
    start = F.struct(begin.cast("long").alias("begin"), end.cast("long").alias("end"))
    void = F.struct(F.lit(1).cast("long").alias("begin"), F.lit(0).cast("long").alias("end"))

    def step(r: Column, e: Column) -> Column:
        shift = e[come] - e[gone]
        moved = F.struct((r["begin"] + shift).cast("long").alias("begin"), (r["end"] + shift).cast("long").alias("end"))
        hit = (r["end"] >= r["begin"]) & (e["offset"] < r["end"])
        return F.when(hit & (r["begin"] < e["offset"] + e[gone]), void).when(hit, moved).otherwise(r)

    return F.aggregate(log, start, step)


def apply_range(log: Column, begin: Column, end: Column) -> Column:
    """A range before the edits -> struct (begin, end) after them; (1, 0), a void range, where an edit touched it."""
    return _move_range(log, begin, end, "remove", "insert")


def revert_range(log: Column, begin: Column, end: Column) -> Column:
    return _move_range(F.reverse(log), begin, end, "insert", "remove")


def edit_logs(edits: DataFrame) -> DataFrame:
    """edits (file_id, seq, offset, remove, insert) -> (file_id, log), a row for each file."""
    e = F.struct("seq", "offset", "remove", "insert")
    got = edits.groupBy("file_id").agg(F.array_sort(F.collect_list(e)).alias("edits"))
    return got.select("file_id", merged_log(F.col("edits")).alias("log"))


def apply_edits(occurrences: DataFrame, logs: DataFrame) -> DataFrame:
    """occurrences (.., file_id, begin, end) after the edits of their files: shifted, without those an edit touched."""
    names = occurrences.columns
    j = occurrences.join(logs, "file_id", "left").withColumn("__r", F.when(F.col("log").isNull(), F.struct(F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"))).otherwise(apply_range(F.col("log"), F.col("begin"), F.col("end"))))
    new = {"begin": F.col("__r.begin"), "end": F.col("__r.end")}
    return j.where(F.col("__r.end") >= F.col("__r.begin")).select(*[new.get(c, F.col(c)).alias(c) for c in names])
