import random
import shlex

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import kinds as K
from skein.functions import paths as P
from skein.functions import positions as O
from skein.functions import text as X


def one(spark, rows, schema, **cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[c.alias(n) for n, c in cols.items()]).collect()]


def merge_log(edits):
    """The log in plain Python."""
    log = []
    for off, rem, ins in edits:
        if log:
            o, r, i = log[-1]
            if off + rem >= o and off <= o + i:
                pre, post = max(o - off, 0), max(off + rem - (o + i), 0)
                log[-1] = (o - pre, r + pre + post, i + ins + pre + post - rem)
                continue
        log.append((off, rem, ins))
    return log


def test_edit_logs_against_plain_python(spark):
    rng = random.Random(4)
    logs = [[(rng.randrange(40), rng.randrange(6), rng.randrange(6)) for _ in range(rng.randrange(1, 7))] for _ in range(300)]
    rows = [(f, s, *e) for f, edits in enumerate(logs) for s, e in enumerate(edits)]
    got = O.edit_logs(spark.createDataFrame(rows, "file_id long, seq long, offset long, remove long, insert long"))
    out = {r.file_id: [(e.offset, e["remove"], e["insert"]) for e in r.log] for r in got.collect()}
    assert out == {f: merge_log(e) for f, e in enumerate(logs)}


def test_single_edit_round_trip(spark):
    """Bytes 4 to 6 replaced by five bytes: 0-3 stay, 6 and on shift by 3, what was inside becomes the edit's place."""
    log = F.array(F.struct(F.lit(4).cast("long").alias("offset"), F.lit(2).cast("long").alias("remove"), F.lit(5).cast("long").alias("insert")))
    rows = [(i,) for i in range(12)]
    got = one(spark, rows, "x long", x=F.col("x"), there=O.apply_offset(log, F.col("x")), back=O.revert_offset(log, O.apply_offset(log, F.col("x"))))
    for x, there, back in got:
        assert there == (x if x < 4 else 4 if x < 6 else x + 3)
        assert O and back == (x if x < 4 or x >= 6 else 4)
    r = one(spark, [(0, 4), (4, 6), (5, 9), (6, 8), (0, 5)], "b long, e long", r=O.apply_range(log, F.col("b"), F.col("e")))
    assert [(x[0]["begin"], x[0]["end"]) for x in r] == [(0, 4), (1, 0), (1, 0), (9, 11), (1, 0)]


def test_line_table_of_36_lines(spark):
    lines = ["x" * 8] * 36
    lines[20], lines[18], lines[35] = "y" * 26, "z" * 8, ""
    t = O.line_table(spark.createDataFrame([(1, "\n".join(lines)), (2, "é\nß"), (3, ""), (4, None)], "file_id long, text string"))
    got = {(r.file_id, r.line): (r.begin, r.len) for r in t.collect()}
    assert len([1 for f, _ in got if f == 1]) == 36
    assert got[1, 20][1] == 27 and got[1, 18][1] == 9
    assert got[2, 1] == (3, 3)  # bytes, not characters
    assert got[3, 0] == (0, 1) and (4, 0) not in got
    probes = spark.createDataFrame([(1, 1, 18, 8), (2, 1, 18, 9), (3, 1, 99, 0)], "probe_id long, file_id long, line long, col long")
    off = {r.probe_id: r.offset for r in O.offset_of(t, probes).collect()}
    assert off == {1: got[1, 18][0] + 8, 2: 0, 3: 0}


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "bb", "..", ".", "", "c.d"]), min_size=1, max_size=7).map("/".join), min_size=1, max_size=30))
def test_normalize_like_posixpath(spark, found):
    import posixpath

    absolute = ["/" + f for f in found]
    got = one(spark, [(x,) for x in found + absolute], "p string", p=F.col("p"), n=P.normalize(F.col("p")))
    for p, n in got:
        want = posixpath.normpath(p) if p else "."
        assert n == ("/" + want.lstrip("/") if p.startswith("/") else want), p


def test_paths(spark):
    c = F.col("p")
    got = one(spark, [("/a/b/c.tar.gz",), ("x",), ("/x",), ("a/",)], "p string", leaf=P.leaf(c), parent=P.parent(c), prefix=P.directory_prefix(c), ext=K.extension(c))
    assert got == [("c.tar.gz", "/a/b", "/a/b/", "gz"), ("x", ".", "", ""), ("x", "/", "/", ""), ("", "a", "a/", "")]
    got = one(spark, [("/a/b",), ("/a",), ("/ab",)], "p string", n=P.nested_in(c, F.lit("/a")), s=P.strictly_nested_in(c, F.lit("/a")), r=P.relative(c, F.lit("/a")))
    assert got == [(True, True, "b"), (True, False, "."), (False, False, "/ab")]


def test_file_kinds(spark):
    cases = {"a.c": 7, "a.C": 8, "a.cc": 8, "a.s": 5, "a.S": 6, "a.ASM": 6, "a.O": 4, "a.obj": 4, "a.A": 3, "a.EXE": 1, "noext": 1, "d.x/noext": 1, "a.h": 2, "a.H": 2, "a.hpp": 0, "a.": 0}
    got = dict(one(spark, [(x,) for x in cases], "p string", p=F.col("p"), k=K.file_kind(F.col("p"))))
    assert got == cases


def test_command_words(spark):
    cases = {
        "gcc -c a.c": ["gcc", "-c", "a.c"],
        'gcc -DX="a b" \'c d\'e # rest "x': ["gcc", "-DX=a b", "c de"],
        'a "q\\"uo\\\\te" \\x': ["a", 'q"uo\\te', "\\x"],
        "  spaced\tout  ": ["spaced", "out"],
        "": [],
        "# only": [],
        'a "b # c" d#e #f "g': ["a", "b # c", "d#e"],
    }
    got = dict(one(spark, [(x,) for x in cases], "l string", l=F.col("l"), w=X.command_words(F.col("l"))))
    assert got == cases
    words = ["plain", "two words", 'quo"te', "back\\slash", "a=b", "x/y.c"]
    (line,) = one(spark, [(words,)], "w array<string>", q=X.quote_line(F.col("w")))[0]
    assert shlex.split(line) == words
    assert one(spark, [(line,)], "l string", w=X.command_words(F.col("l")))[0][0] == words


def test_trailing_identifier(spark):
    cases = {"  return sim": "sim", "x.": "", "12ab": "ab", "a1": "a1", "": "", "9": ""}
    got = one(spark, [(x,) for x in cases], "t string", t=F.col("t"), i=X.trailing_identifier(F.col("t")), at=X.insert_position(F.col("t"), F.lit(100)))
    assert {t: i for t, i, _ in got} == cases
    assert all(at == 100 - len(i) for _, i, at in got)


def test_make_patterns(spark):
    rows = [("%.c", "d/x.c", "d/x"), ("src/%.c", "src/x.c", "x"), ("p%.c", "tip/foo/px.c", "tip/foo/x"), ("%.c", "x.cpp", None), ("all", "all", ""), ("all", "x", None), ("a%a", "a", None)]
    got = one(spark, rows, "p string, s string, want string", got=X.pattern_stem(F.col("p"), F.col("s")), want=F.col("want"))
    assert all(a == b for a, b in got), got


def test_flags(spark):
    w = F.col("w")
    cases = {"-Ifoo": "path-joined", "-I": "path-next", "-isystem": "path-joined", "-x": "arg-next", "-Xlinker": "arg-next", "-Wall": "plain", "a.c": "source", "-o": "path-next"}
    got = dict(one(spark, [(x,) for x in cases], "w string", w=w, r=X.flag_role(w)))
    assert {k: v for k, v in got.items() if k != "-isystem"} == {k: v for k, v in cases.items() if k != "-isystem"}
    ign = dict(one(spark, [(x,) for x in ("-mcpu=x", "-mfloat-abi=hard", "-MMD", "-c", "-O2", "-fplugin=x", "--help=all")], "w string", w=w, i=X.flag_ignored(w)))
    assert ign == {"-mcpu=x": True, "-mfloat-abi=hard": False, "-MMD": True, "-c": True, "-O2": False, "-fplugin=x": True, "--help=all": True}
