"""Paths: normal forms, parts and nesting. All on slashes; case is kept, as on Linux."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(path: Column) -> Column:
    """Without empty and single-dot parts, and with double-dot parts taken back where there is something to take back.

    An absolute path's double dots stop at the root; a relative path keeps those it starts with. '' becomes '.'.
    """
    absolute = path.startswith("/")

    def step(acc: Column, part: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        back = F.when((F.size(acc) > 0) & (last != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.concat(acc, F.array(part)))
        return F.when((part == "") | (part == "."), acc).when(part == "..", back).otherwise(F.concat(acc, F.array(part)))

    parts = F.aggregate(F.split(path, "/", -1), F.array().cast("array<string>"), step)
    text = F.array_join(parts, "/")
    return F.when(absolute, F.concat(F.lit("/"), text)).when(text == "", ".").otherwise(text)


def is_absolute(path: Column) -> Column:
    return path.startswith("/")


def join(base: Column, path: Column) -> Column:
    """path seen from base: path itself if it is absolute or base is empty."""
    slash = F.when(base.endswith("/"), F.lit("")).otherwise(F.lit("/"))
    return F.when(is_absolute(path) | (base == ""), path).when(path == "", base).otherwise(F.concat(base, slash, path))


def absolute(path: Column, base: Column) -> Column:
    return normalize(join(base, path))


def leaf(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def directory_prefix(path: Column) -> Column:
    """Everything up to and with the last slash; empty without one."""
    return F.regexp_extract(path, r"^(.*/)", 1)


def parent(path: Column) -> Column:
    """The directory that holds path: '/' for what stands in the root, '.' for a bare name."""
    d = directory_prefix(path)
    return F.when(d == "", ".").when(d == "/", "/").otherwise(F.regexp_replace(d, "/+$", ""))


def nested_in(path: Column, directory: Column) -> Column:
    """Equal to the directory or below it, at a slash."""
    return (path == directory) | strictly_nested_in(path, directory)


def strictly_nested_in(path: Column, directory: Column) -> Column:
    return F.when(directory == "/", path.startswith("/") & (path != "/")).otherwise(path.startswith(F.concat(directory, F.lit("/"))))


def relative(path: Column, base: Column) -> Column:
    """path below base without base; other paths as they are. The base itself is '.'."""
    skip = F.when(base == "/", F.lit(1)).otherwise(F.length(base) + 1)
    return F.when(path == base, ".").when(strictly_nested_in(path, base), F.substring(path, skip + 1, F.length(path))).otherwise(path)


def natural(path: Column, base: Column) -> Column:
    """The shorter way to write an absolute path for someone in base: relative below base, absolute elsewhere."""
    return relative(path, base)


def portable_code(path: Column, project: Column, toolchain: Column) -> Column:
    """A path for a cache that may move: '.' and the rest below the project, '_' and the rest below the toolchain, the
    absolute path elsewhere."""
    return (
        F.when(nested_in(path, project), F.concat(F.lit("."), F.substring(path, F.length(project) + 1, F.length(path))))
        .when(nested_in(path, toolchain), F.concat(F.lit("_"), F.substring(path, F.length(toolchain) + 1, F.length(path))))
        .otherwise(path)
    )


def from_portable_code(code: Column, project: Column, toolchain: Column) -> Column:
    rest = F.substring(code, 2, F.length(code))
    return F.when(code.startswith("."), F.concat(project, rest)).when(code.startswith("_"), F.concat(toolchain, rest)).otherwise(code)


def signature(mtime: Column, size: Column) -> Column:
    """A cheap sign of change: both bits together, not a content hash."""
    return mtime.cast("long").bitwiseXOR(size.cast("long"))
