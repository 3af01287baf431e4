"""Enumerations and the predicates over their codes. The order of codes carries meaning: ladders and masks rely on it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The enumerations in code order.
ENTITY_KINDS = ["none", "global symbol", "global variable", "global function", "virtual function", "variable template", "function template", "class template", "template parameter", "struct", "union", "enum", "section", "file", "unit-local symbol", "local static variable", "static variable", "automatic variable", "parameter", "local function", "type", "field", "enum constant", "macro", "class", "other"]
OCCURRENCE_KINDS = ["definition", "tentative definition", "weak definition", "declaration", "weak declaration", "use", "weak use", "include", "none"]
STYLES = ["unspecified", "data", "function", "virtual function"]
LINK_STATUSES = ["none", "weakly undefined", "undefined", "weakly defined", "tentatively defined", "defined", "multiply defined"]
LINKER_STATUSES = ["waiting", "busy", "done", "error"]
ANALYSIS_STATUSES = ["none", "waiting", "busy", "done", "failed"]
PROJECT_STATUSES = ["ready", "busy", "failed"]
INCLUSION_STATUSES = ["excluded", "included"]
FILE_MODES = ["exclude", "include", "automatic"]
FILE_KINDS = ["other", "executable", "header", "archive", "object", "assembler", "assembler-with-cpp", "C", "C++"]
SEVERITIES = ["warning", "error", "fatal"]
CATEGORIES = ["none", "toolchain", "makefile"]
ENUMS = {
    "entity_kind": ENTITY_KINDS, "occurrence_kind": OCCURRENCE_KINDS, "style": STYLES, "link_status": LINK_STATUSES, "linker_status": LINKER_STATUSES,
    "analysis_status": ANALYSIS_STATUSES, "project_status": PROJECT_STATUSES, "inclusion_status": INCLUSION_STATUSES, "file_mode": FILE_MODES, "file_kind": FILE_KINDS,
    "severity": SEVERITIES, "category": CATEGORIES,
}

# Occurrence kinds by name.
DEFINITION, TENTATIVE, WEAK_DEFINITION, DECLARATION, WEAK_DECLARATION, USE, WEAK_USE, INCLUDE = range(8)
DATA, FUNCTION, VIRTUAL = 1, 2, 3
EXCLUDE_MODE, INCLUDE_MODE, AUTOMATIC_MODE = range(3)
ARCHIVE, OBJECT, ASSEMBLER, ASSEMBLER_CPP = 3, 4, 5, 6


def enum_dim(spark: SparkSession) -> DataFrame:
    """(enum, code, name): every enumeration as a small dimension table."""
    rows = [(e, i, n) for e, names in ENUMS.items() for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "enum string, code int, name string")


def enum_name(enum: str, code: Column) -> Column:
    """Name of a code; null for codes the enumeration doesn't have."""
    return F.get(F.array(*[F.lit(n) for n in ENUMS[enum]]), code.cast("int"))


def enum_code(enum: str, name: Column, missing: int | None = None) -> Column:
    """Code of a name; `missing` for names the enumeration doesn't have."""
    at = F.array_position(F.array(*[F.lit(n) for n in ENUMS[enum]]), name)
    return F.when(at > 0, (at - 1).cast("int")).otherwise(F.lit(missing).cast("int"))


def extension(path: Column) -> Column:
    """What follows the last dot of the leaf; empty if there is none."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


# The extensions of each kind of file, below.
def file_kind(path: Column) -> Column:
    """File-kind code by extension: sources by exact case, objects, archives and executables in any case."""
    ext, low = extension(path), F.lower(extension(path))
    has_dot = path.rlike(r"\.[^./]*$")
    return (
        F.when(~has_dot | (low == "exe"), 1)
        .when(ext == "c", 7)
        .when(ext.isin("C", "cpp", "cxx", "c++", "cp", "cc"), 8)
        .when(ext.isin("s", "asm"), 5)
        .when(ext.isin("S", "ASM"), 6)
        .when(low.isin("o", "obj"), 4)
        .when(low == "a", 3)
        .when(ext.isin("h", "H"), 2)
        .otherwise(0)
    )


def is_source(kind: Column) -> Column:
    return kind >= ASSEMBLER


def is_preprocessed(kind: Column) -> Column:
    return kind >= ASSEMBLER_CPP


def is_linkable(kind: Column) -> Column:
    return kind >= ARCHIVE


def is_global(entity_kind: Column) -> Column:
    return entity_kind.between(1, 4)


def is_symbol(entity_kind: Column) -> Column:
    return entity_kind != 13


def is_local(entity_kind: Column) -> Column:
    return is_symbol(entity_kind) & ~is_global(entity_kind)


def is_variable(entity_kind: Column) -> Column:
    return entity_kind.isin(2, 15, 16, 17, 18)


def is_definition(kind: Column) -> Column:
    return kind <= WEAK_DEFINITION


def is_declaration(kind: Column) -> Column:
    """Definitions count as declarations."""
    return kind <= WEAK_DECLARATION


def in_mask(mask: Column | int, kind: Column) -> Column:
    """Whether a kind's bit is set in a mask."""
    m = F.lit(mask) if isinstance(mask, int) else mask
    return F.bit_get(m.cast("long"), kind.cast("int")) == 1


# Symbol letters of binary listings -> (occurrence kind, style).
NM_LETTERS = {
    "A": (DEFINITION, 0), "B": (DEFINITION, DATA), "D": (DEFINITION, DATA), "G": (DEFINITION, DATA), "L": (DEFINITION, DATA), "R": (DEFINITION, DATA), "S": (DEFINITION, DATA),
    "C": (TENTATIVE, DATA), "T": (DEFINITION, FUNCTION), "U": (USE, 0), "u": (WEAK_DEFINITION, 0), "V": (WEAK_DEFINITION, DATA), "W": (WEAK_DEFINITION, FUNCTION), "v": (WEAK_USE, 0), "w": (WEAK_USE, 0),
}


def nm_kind(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (o, _) in NM_LETTERS.items() for x in (k, o)]), letter)


def nm_style(letter: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (_, s) in NM_LETTERS.items() for x in (k, s)]), letter)


def is_builtin(name: Column) -> Column:
    """Names that the compiler provides."""
    return name.startswith("__builtin_") | name.isin("fabs", "ITM_RxBuffer")


def link_candidate(kind: Column, mode: Column, in_command: Column) -> Column:
    return is_linkable(kind) & ((mode == INCLUDE_MODE) | ((mode == AUTOMATIC_MODE) & (kind != OBJECT)) | in_command)


def unit_linked(hard: Column, mode: Column, soft: Column, relevant_error: Column) -> Column:
    return (hard > 0) | (mode == INCLUDE_MODE) | ((mode == AUTOMATIC_MODE) & ((soft > 0) | relevant_error))


def allowed_in_step(is_current_archive: Column, candidate: Column, in_command: Column, kind: Column) -> Column:
    return is_current_archive | ((candidate | in_command) & ~((kind == ARCHIVE) & in_command))


# Characters that stand for kinds and styles in the analysis cache, one for each code; a blank has none.
ENTITY_CODES = " CVFbwgdhrunN cvsapftmeMlo"
OCCURRENCE_CODES = "DCWdwuvi"
STYLE_CODES = "udfv"


def cache_char(codes: str, kind: Column) -> Column:
    return F.substring(F.lit(codes), kind.cast("int") + 1, 1)


def from_cache_char(codes: str, char: Column) -> Column:
    """Code of a character; the first one for a character that stands for several, null for others."""
    return F.when(F.length(char) == 1, F.nullif(F.instr(F.lit(codes), char), F.lit(0)) - 1).cast("int")
