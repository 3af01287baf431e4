"""Text: identifiers, make patterns, command words and small tests on strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trailing_identifier(context: Column) -> Column:
    """The identifier that a context ends with: the longest tail of word characters, without the digits it starts with."""
    return F.regexp_extract(context, r"([A-Za-z_][A-Za-z0-9_]*)$", 1)


def insert_position(context: Column, position: Column) -> Column:
    """Where a completion of the trailing identifier starts, in bytes."""
    return (position - F.octet_length(trailing_identifier(context))).cast("long")


def common_prefix_length(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i)))
    return F.coalesce(F.array_max(same), F.lit(0)).cast("int")


def begins_with_at(text: Column, at: Column, other: Column) -> Column:
    """Whether other stands in text at a zero-based place; other may not stick out."""
    return F.coalesce(F.substring(text, at + 1, F.length(other)) == other, F.lit(False))


def remove_char(text: Column, char: str) -> Column:
    return F.replace(text, F.lit(char))


def remove_prefix(text: Column, prefix: Column) -> Column:
    return F.when(text.startswith(prefix), F.substring(text, F.length(prefix) + 1, F.length(text))).otherwise(text)


def remove_suffix(text: Column, suffix: Column) -> Column:
    return F.when(text.endswith(suffix), F.substring(text, F.lit(1), F.length(text) - F.length(suffix))).otherwise(text)


def unix_lines(text: Column) -> Column:
    return F.replace(text, F.lit("\r\n"), F.lit("\n"))


def is_named_goal(name: Column) -> Column:
    return name.rlike(r"^[A-Za-z][A-Za-z0-9_-]*$")


def pattern_stem(pattern: Column, source: Column) -> Column:
    """The stem of a make pattern in a source path, null where they don't match.

    A pattern without a slash is matched against the leaf, and the stem keeps the source's directory in front. A pattern
    without % matches its own text alone, with an empty stem.
    """
    at = F.instr(pattern, "%")
    prefix, suffix = F.substring(pattern, F.lit(1), at - 1), F.substring(pattern, at + 1, F.length(pattern))
    bare = F.instr(pattern, "/") == 0
    folder = F.when(bare, F.regexp_extract(source, r"^(.*/)", 1)).otherwise("")
    name = F.substring(source, F.length(folder) + 1, F.length(source))
    fits = (F.length(name) >= F.length(prefix) + F.length(suffix)) & name.startswith(prefix) & name.endswith(suffix)
    stem = F.concat(folder, F.substring(name, F.length(prefix) + 1, F.length(name) - F.length(prefix) - F.length(suffix)))
    return F.when(at == 0, F.when(pattern == source, F.lit(""))).otherwise(F.when(fits, stem))


def pattern_fill(pattern: Column, stem: Column) -> Column:
    """The pattern with its first % replaced. A stem's directory goes in front of a pattern's own name."""
    at = F.instr(pattern, "%")
    return F.when(at == 0, pattern).otherwise(F.concat(F.substring(pattern, F.lit(1), at - 1), stem, F.substring(pattern, at + 1, F.length(pattern))))


def command_words(line: Column) -> Column:
    """Words of a command line: quoted parts lose their quotes and, before a quote or backslash of theirs, backslashes;
    a # at the start of a word ends the line.

    One regular expression cuts the words, a second the parts of each word, so no Python runs.
    """
    word = r"""(?:"(?:\\["\\]|[^"])*"?|'(?:\\['\\]|[^'])*'?|[^\s"'])+"""
    # a comment is taken where a word would start, so a # within quotes or a word is none
    words = F.filter(F.regexp_extract_all(line, F.lit(f"((?s:#.*)|{word})"), F.lit(1)), lambda w: ~w.startswith("#"))
    part = r"""("(?:\\["\\]|[^"])*"?|'(?:\\['\\]|[^'])*'?|[^"']+)"""

    def bare(p: Column) -> Column:
        d = F.regexp_replace(F.regexp_replace(p, r'^"|(?<!\\)"$', ""), r'\\(["\\])', "$1")
        s = F.regexp_replace(F.regexp_replace(p, r"^'|(?<!\\)'$", ""), r"\\(['\\])", "$1")
        return F.when(p.startswith('"'), d).when(p.startswith("'"), s).otherwise(p)

    return F.transform(words, lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(part), F.lit(1)), bare), ""))


def quote_word(word: Column) -> Column:
    """A word as a shell reads it back: as it is where that is safe, else in double quotes."""
    return F.when(word.rlike(r"^[A-Za-z0-9_@%+=:,./-]+$"), word).otherwise(F.concat(F.lit('"'), F.regexp_replace(word, r'(["\\])', r"\\$1"), F.lit('"')))


def quote_line(words: Column) -> Column:
    return F.array_join(F.transform(words, quote_word), " ")


# Targets that the analysis front end knows under another name, and one that it doesn't know.
TARGETS = {"riscv-none-embed": "riscv32", "riscv-none-elf": "riscv32", "riscv32-unknown-elf": "riscv32"}
NO_TARGET = "pic30-elf"


def target_flags(target: Column) -> Column:
    """['-target', name], or nothing for targets that have no counterpart."""
    fixed = target
    for a, b in TARGETS.items():
        fixed = F.when(target == a, b).otherwise(fixed)
    return F.when((target == "") | (target == NO_TARGET), F.array().cast("array<string>")).otherwise(F.array(F.lit("-target"), fixed))


def macro_flags(header: Column, value: Column) -> Column:
    """['-Uname', '-Dheader=value'] for a macro, nothing for the two that have a meaning of their own."""
    name = F.regexp_extract(header, r"^([^(]*)", 1)
    return F.when(name.isin("__has_include", "__has_include_next"), F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("-U"), name), F.concat(F.lit("-D"), header, F.lit("="), F.coalesce(value, F.lit("")))))


def pointer_flag(size: Column) -> Column:
    """-m with the pointer's bits for a macro value that is a positive number, else null."""
    return F.when(size.rlike(r"^[0-9]+$") & (size.cast("int") > 0), F.concat(F.lit("-m"), (size.cast("int") * 8).cast("string")))


# How compiler flags are sorted.
PATH_FLAGS = ["-o", "-L", "-I", "-isystem", "-include", "-imacros", "-idirafter", "-iprefix", "-MF", "-T"]
ARG_FLAGS = ["-u", "-MT", "-MQ", "-A", "-x", "--param"]
NONLINK_FLAGS = ["-c", "-S", "-E"]
IGNORED_WORDS = ["-c", "-v", "-E", "-S", "-u", "-L", "-T", "-###", "--param", "-pipe", "-wrapper", "--version", "--target-help", "-dumpdir", "-fada-spec-parent", "-fno-fat-lto-objects"]
IGNORED_STARTS = ["-M", "-o", "-m", "--help", "-dumpbase", "-ffile-prefix-map", "-fplugin", "-fdump"]
KEPT_START = "-mfloat-abi="


def flag_ignored(word: Column) -> Column:
    starts = F.lit(False)
    for s in IGNORED_STARTS:
        starts = starts | word.startswith(s)
    return (word.isin(*IGNORED_WORDS) | starts) & ~word.startswith(KEPT_START)


def path_flag(word: Column) -> Column:
    """The path flag that a word starts with, the first of the list; null for others."""
    out = F.lit(None).cast("string")
    for f in reversed(PATH_FLAGS):
        out = F.when(word.startswith(f), f).otherwise(out)
    return out


def flag_role(word: Column) -> Column:
    """path-joined, path-next, arg-next or plain for flags, source for words without a dash."""
    pf = path_flag(word)
    return (
        F.when(~word.startswith("-"), "source")
        .when(pf.isNotNull() & (F.length(word) > F.length(pf)), "path-joined")
        .when(pf.isNotNull(), "path-next")
        .when(word.startswith("-X") | word.isin(*ARG_FLAGS), "arg-next")
        .otherwise("plain")
    )


def is_nonlink(word: Column) -> Column:
    return word.isin(*NONLINK_FLAGS)


def builtin_relevant(word: Column) -> Column:
    return word.startswith("-m") | word.startswith("-f") | word.startswith("-std")
