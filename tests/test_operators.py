import random

from pyspark.sql import functions as F

from skein.operators import closure, completion, counters, link, lookups, ordered
from skein.plans.catalog import QUERIES
from skein.sources import readers


def resolver(roots, defs, reqs, archives=()):
    """Link resolution in plain Python, by a work list: defs {name: [(section, tier)]}, reqs {section: {names}}."""
    linked, resolved, todo = set(), set(roots), list(roots)

    def step(allowed):
        nonlocal todo
        left = []
        while todo:
            n = todo.pop()
            hit = [s for s, t in allowed.get(n, []) if t == 0]
            if not hit:
                left.append(n)
            for s in hit:
                if s not in linked:
                    linked.add(s)
                    for r in reqs.get(s, ()):
                        if r not in resolved:
                            resolved.add(r)
                            todo.append(r)
        have = {n for n, ds in allowed.items() if any(s in linked for s, _ in ds)}
        todo = [n for n in left if n not in have]
        left = []
        while todo:
            n = todo.pop()
            tiers = sorted({t for _, t in allowed.get(n, [])})
            if not tiers:
                left.append(n)
                continue
            for s, t in allowed[n]:
                if t == tiers[0] and s not in linked:
                    linked.add(s)
                    for r in reqs.get(s, ()):
                        if r not in resolved:
                            resolved.add(r)
                            todo.append(r)
        todo = left

    step(defs)
    for group in archives:
        while True:
            before = len(linked)
            for a in group:
                both = {n: defs.get(n, []) + a.get(n, []) for n in {*defs, *a}}
                step(both)
            if len(group) == 1 or len(linked) == before:
                break
    return linked


def frame(spark, defs):
    rows = [(n, s, t) for n, ds in defs.items() for s, t in ds]
    return spark.createDataFrame(rows, "name long, section_id long, tier int")


def test_link_against_a_work_list(spark):
    rng = random.Random(9)
    for _ in range(1):
        names = range(25)
        defs, arch, reqs = {}, {}, {}
        for s in range(40):
            (arch if s >= 28 else defs).setdefault(rng.choice(names), []).append((s, rng.choice([0, 0, 1, 2])))
            reqs[s] = {rng.choice(names) for _ in range(rng.randrange(3))}
        req_df = spark.createDataFrame([(s, n, False) for s, ns in reqs.items() for n in ns], "section_id long, name long, weak boolean")
        root = spark.createDataFrame([(0,), (1,)], "name long")
        got = {r.section_id for r in link.link(root, frame(spark, defs), req_df).collect()}
        assert got == resolver([0, 1], defs, reqs)
        got = {r.section_id for r in link.link(root, frame(spark, defs), req_df, [[frame(spark, arch)]]).collect()}
        assert resolver([0, 1], defs, reqs) <= got


def test_link_status_ladder(spark):
    facts = [("m", "strong", 2), ("d", "strong", 1), ("s", "script", 1), ("t", "tentative", 3), ("w", "weak", 1), ("b", "builtin", 1), ("p", "provide", 1), ("u", "required", 1), ("x", "weakly_required", 1), ("d", "weak", 5), ("u", "weakly_required", 1)]
    got = {r.name: r.status for r in counters.link_status(spark.createDataFrame(facts, "name string, fact string, n long")).collect()}
    assert got == {"m": 6, "d": 5, "s": 5, "t": 4, "w": 3, "b": 3, "p": 3, "u": 2, "x": 1}


def test_closure_ends_on_cycles_and_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(40, 0)], "src long, dst long")
    got = closure.reachable(edges, spark.createDataFrame([(0, 0), (7, 100)], "root long, node long"))
    assert {(r.root, r.node) for r in got.collect()} == {(0, i) for i in range(41)} | {(7, 100)}


def test_scope_stack_against_a_stack(spark):
    rng = random.Random(2)
    rows = [(u, s, rng.choice([1, 1, -1])) for u in range(30) for s in range(rng.randrange(1, 14))]
    want = set()
    for u in {r[0] for r in rows}:
        stack, inside, parent, depth = [], {}, {}, {}
        for _, s, d in (r for r in rows if r[0] == u):
            if d == 1:
                for o in stack:
                    inside[o] += 1
                parent[s], depth[s], inside[s] = stack[-1] if stack else None, len(stack) + 1, 0
                stack.append(s)
            elif stack:
                stack.pop()
        want |= {(u, s, depth[s], parent[s], inside[s]) for s in parent}
    got = ordered.scope_stack(spark.createDataFrame(rows, "unit_id long, seq long, d int"))
    assert {(r.unit_id, r.seq, r.depth, r.parent_seq, r.n_inside) for r in got.collect()} == want


def test_scopes_of_spans(spark):
    # 0 holds 1 and 3; 1 holds 2; 4 stands alone
    spans = spark.createDataFrame([(1, 0, 3), (1, 1, 1), (1, 2, 0), (1, 3, 0), (1, 4, 0)], "unit_id long, seq long, count long")
    assert {(r.seq, r.parent_seq) for r in lookups.scopes_of(spans).collect()} == {(0, None), (1, 0), (2, 1), (3, 0), (4, None)}


def test_choose_target_is_the_fold(spark, sf):
    from skein.plans.relations import spark_relation

    files = spark_relation(spark, sf, "r_file").select("file_id", "path")
    targets = lookups.rule_targets(files, spark_relation(spark, sf, "r_rule"))
    by = {}
    for r in targets.collect():
        by.setdefault(r.file_id, []).append((r.target, r.stem))
    want = {}
    for r in files.collect():
        best = stem = None
        have = False
        for t, s in sorted(by.get(r.file_id, [])):
            o = t.rpartition(".")[2].lower() in ("o", "obj")
            if best is None or len(s) < len(stem) or (o and not have):
                best, stem, have = t, s, o
        want[r.file_id] = best or r.path + ".o"
    assert {r.file_id: r.target for r in QUERIES["j7b_choose_target"](spark, sf).collect()} == want


def simple_project(spark):
    """A small project: simple.c defines and simple.h declares a function that main uses."""
    occ = [
        (1, 57, 63, "simple", 0, 3, True), (1, 10, 18, "simple.h", 7, 13, True), (2, 5, 11, "simple", 3, 3, True), (2, 20, 26, "SIMPLE", 0, 23, True), (3, 30, 36, "simple", 5, 3, True), (3, 0, 4, "main", 0, 3, True), (2, 40, 47, "simple2", 3, 3, True), (2, 50, 53, "arg", 0, 18, True),
    ]
    return spark.createDataFrame(occ, "file_id long, begin long, end long, entity_id string, kind int, entity_kind int, instantiated boolean").withColumn("name", F.col("entity_id"))


def test_click_edges_and_counts(spark):
    o = simple_project(spark)
    probes = spark.createDataFrame([(1, 1, 56), (2, 1, 57), (3, 1, 63), (4, 1, 64), (5, 1, 12)], "probe_id long, file_id long, offset long")
    got = {r.probe_id: r.entity_id for r in lookups.occurrence_at(o, probes, 0, 1).collect()}
    assert got == {2: "simple", 3: "simple", 5: "simple.h"}  # the place after a name still hits it, the one before doesn't
    lists = lookups.occurrences_of(o, o.where("entity_id = 'simple'")).groupBy("list").count().collect()
    assert {r["list"]: r["count"] for r in lists} == {"defs": 2, "uses": 1}
    assert {r.entity_id: r.has_definition for r in counters.has_definition(o.where("entity_id in ('simple', 'main')")).collect()} == {"simple": True, "main": True}


def test_completion(spark):
    o = simple_project(spark)
    req = spark.createDataFrame([(1, 1, 69, "  return sim")], "request_id long, file_id long, pos long, context string")
    inc = spark.createDataFrame([(1, 2), (2, 1)], "includer long, included long")
    got = {(r.name, r.insert_at) for r in completion.completions(req, o, inc).collect()}
    assert got == {("simple", 66), ("simple2", 66)}


def test_limits_show_and_hide(spark):
    d = spark.createDataFrame([(1, i) for i in range(30)], "severity int, seq long")
    for limit, want in ((10, (10, 20)), (40, (30, 0)), (30, (30, 0))):
        r = ordered.hidden_diagnostics(d, limit).first()
        assert (r.shown, r.hidden) == want
        assert ordered.top_diagnostics(d, ["seq"], limit).count() == want[0]


def test_multi_line_records(spark):
    text = ["@/a.ld", "i12 x.ld", "/inc", "S5 .text", "FLASH", "ROM", "F7 main", "", "u3:4 foo bar", "@", "u foo"]
    d = readers.event_statements(spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "stream string, seq long, line string"))
    got = [(r.code, r.file, r.offset, r.line, r.col, r["name"], r.extra) for r in d.orderBy("seq").collect()]
    assert got == [
        ("@", "/a.ld", None, None, None, "/a.ld", None), ("i", "/a.ld", 12, None, None, "x.ld", "/inc"), ("S", "/a.ld", 5, None, None, ".text", "FLASH|ROM"), ("F", "/a.ld", 7, None, None, "main", None),
        ("u", "/a.ld", None, 3, 4, "foo bar", None), ("@", None, None, None, None, "", None), ("u", None, None, None, None, "foo", None),
    ]


def test_tool_output_readers(spark, tmp_path):
    lines = lambda *x: spark.createDataFrame([("s", i, t) for i, t in enumerate(x)], "stream string, seq long, line string")
    nm = readers.nm_symbols(lines("lib.o:", "00000000 00000032 T Delay_Init", "         U SystemCoreClock", "00000000 b local")).collect()
    assert [(r.member, r.letter, r.name, r.kind, r.style) for r in nm] == [("lib.o", "T", "Delay_Init", 0, 2), ("lib.o", "U", "SystemCoreClock", 5, 0)]
    db = readers.make_database(lines("# Implicit Rules", "%.o: %.c", "# Files", "all: a.o b.o", "\tgcc x", "X := y", "empty:")).collect()
    assert {(r.section, r.target, r.prerequisite) for r in db} == {("Implicit Rules", "%.o", "%.c"), ("Files", "all", "a.o"), ("Files", "all", "b.o"), ("Files", "empty", None)}
    dirs = readers.include_dirs(lines("x", "#include <...> search starts here:", " /usr/inc", "End of search list.", " /no"))
    assert [r.dir for r in dirs.collect()] == ["/usr/inc"]
    path = tmp_path / "t.txt"
    path.write_text("a\nb\n")
    assert [(r.seq, r.line) for r in readers.text_lines(spark, str(path)).orderBy("seq").collect()] == [(0, "a"), (1, "b"), (2, "")]


def test_cache_replaces_only_its_units(spark, tmp_path):
    path = str(tmp_path / "cache")
    readers.write_cache(spark.createDataFrame([(1, "a"), (2, "b")], "unit_id long, v string"), path)
    readers.write_cache(spark.createDataFrame([(2, "c"), (66, "d"), (65, "e")], "unit_id long, v string"), path)
    readers.write_cache(spark.createDataFrame([(66, "f")], "unit_id long, v string"), path)
    assert {(r.unit_id, r.v) for r in readers.cached_results(spark, path).collect()} == {(1, "a"), (2, "c"), (65, "e"), (66, "f")}


def test_missing_header_and_includers(spark):
    m = spark.createDataFrame([(1, "../inc/x.h"), (2, "x.h"), (3, "nc/x.h")], "unit_id long, header string")
    p = spark.createDataFrame([("/p/inc/x.h",)], "path string")
    assert {(r.unit_id) for r in lookups.missing_header_matches(m, p).collect()} == {1, 2}


def test_unions_of_equal_partitionings(spark):
    """A window above a union of a frame with itself sees whole groups."""
    from pyspark.sql import Window

    rows = [(u, s) for u in range(30) for s in range(9)]
    e = spark.createDataFrame(rows, "u long, s long").withColumn("n", F.row_number().over(Window.partitionBy("u").orderBy("s")))
    both = e.select("u", "s", "n").union(e.select("u", "s", (F.col("n") + 1).alias("n")))
    got = both.withColumn("k", F.count(F.lit(1)).over(Window.partitionBy("u", "n"))).groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {1: 60, 2: 480}


def test_script_statements(spark):
    text = ["@/a.ld", "L4096 512 RAM", "L1 x bad", "E3 undefined symbol: foo", "E1:2 real error"]
    d = readers.event_statements(spark.createDataFrame([("s", i, t) for i, t in enumerate(text)], "stream string, seq long, line string"), with_raw=True)
    assert [tuple(r) for r in readers.memory_regions(d).collect()] == [("s", "RAM", 4096, 512)]
    assert [(r.line, r.col, r.message) for r in readers.script_diagnostics(d).collect()] == [(1, 2, "real error")]


def test_files_come_and_go(spark):
    files = spark.createDataFrame([(1, "/p/a.c", 2), (2, "/p/inc/x.h", 2)], "file_id long, path string, mode int")
    missing = spark.createDataFrame([(7, "inc/y.h")], "unit_id long, header string")
    after, wake = lookups.add_files(files, spark.createDataFrame([(3, "/p/inc/y.h", 1)], "file_id long, path string, mode int"), missing)
    assert after.count() == 3 and [r.unit_id for r in wake.collect()] == [7]
    inc = spark.createDataFrame([(1, 2)], "includer long, included long")
    after, again = lookups.remove_files(files, files.where("file_id = 2"), inc)
    assert {r.file_id: r["mode"] for r in after.collect()} == {1: 2, 2: 0} and {r.file_id for r in again.collect()} == {1, 2}


def taken(lines):
    """Statements of the line protocol by a plain loop."""
    out, i = [], 0
    while i < len(lines):
        out.append(i)
        i += 1 + {"i": 1, "S": 2}.get(lines[i][:1], 0)
    return [k for k in out if lines[k]]


def test_lines_that_are_taken_take_nothing(spark):
    rng = random.Random(7)
    streams = {"a": ["S1 .data", "SRAM", "FLASH", "u5 main", "i12 foo.h", "include/sub", "u40 bar"], "b": ["i1 x"], "c": ["S1 x", "i"], "d": [""]}
    streams |= {f"r{n}": [rng.choice(["S1 .t", "i1 h", "u1 x", "", "@f", "SRAM", "inc"]) for _ in range(rng.randrange(1, 60))] for n in range(30)}
    rows = [(s, i, t) for s, lines in streams.items() for i, t in enumerate(lines)]
    got = readers.event_statements(spark.createDataFrame(rows, "stream string, seq long, line string")).select("stream", "seq").collect()
    assert sorted(map(tuple, got)) == sorted((s, i) for s, lines in streams.items() for i in taken(lines))


def test_definition_sections(spark):
    defs = spark.createDataFrame([("f", 1, 0), ("g", 2, 2)], "name string, occ_id int, tier int")
    held = spark.createDataFrame([(10, 1), (10, 1), (11, 1), (12, 2)], "section_id int, occ_id int")
    sections = spark.createDataFrame([(10, 100), (11, 101), (12, 102)], "section_id int, file_id int")
    files = spark.createDataFrame([(100, True), (101, False), (102, True)], "file_id int, allowed boolean")
    assert sorted(map(tuple, link.definition_sections(defs, held, sections, files).collect())) == [("f", 10, 0), ("g", 12, 2)]


def test_long_values_of_link_commands(spark):
    word = "-L" + "d" * 5000
    got = readers.link_command_items(spark.createDataFrame([("s", 0, word), ("s", 1, "--defsym=" + "x" * 3000 + "=1")], "stream string, pos int, word string"))
    assert {r.pos: len(r.value) for r in got.collect()} == {0: 5000, 1: 3000}


def test_closure_of_all_files_contracts_cycles(spark):
    import random

    from skein.operators.closure import cycle_classes, reachable, reachable_from_all

    rnd = random.Random(3)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(70)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(7, 100), (105, 200), (5, 5)}
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    seeds = spark.createDataFrame([(x, x) for x in [*range(60), 103, 200, 999]], "root long, node long")

    def walk(x):
        seen, todo = {x}, [x]
        while todo:
            y = todo.pop()
            for a, b in pairs:
                if a == y and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    want = sorted((x, y) for x in [*range(60), 103, 200, 999] for y in walk(x))
    assert sorted(map(tuple, reachable_from_all(edges, seeds).collect())) == want
    assert sorted(map(tuple, reachable(edges, seeds).collect())) == want
    for node, cls in map(tuple, cycle_classes(edges, 2).collect()):  # true after any number of rounds
        assert cls in walk(node) and node in walk(cls)
    assert reachable_from_all(edges.limit(0), seeds.limit(0)).count() == 0


def test_closure_of_all_files_takes_little_room(spark, tmp_path):
    """Files that all reach each other: their pairs are as many as their square, but come in an order that files hold well."""
    from skein.operators.closure import reachable_from_all

    n = 1500
    edges = spark.createDataFrame([(0, i) for i in range(1, n)] + [(i, 0) for i in range(1, n)], "src long, dst long")
    seeds = spark.createDataFrame([(i, i) for i in range(n)] + [(n, 3), (n, 4), (n, n + 1)], "root long, node long")
    reachable_from_all(edges, seeds).write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == n * n + n + 1
    assert sum(p.stat().st_size for p in tmp_path.glob("pairs/*.parquet")) < 0.5 * n * n


def test_clicks_are_looked_up_in_chunks_of_text(spark, sf):
    """Words of chunks are the relation's; clicks hit what they hit among all occurrences; no window runs over all words."""
    from skein.functions import positions
    from skein.plans import catalog
    from skein.plans.relations import relation_over

    rng = random.Random(5)
    texts = ["", "\n", " ", "a", "a b", " a\n\nb ", None, "é ü\nß", *[" ".join(rng.choice(["x", "", "word", "ö.", "y\nz"]) for _ in range(rng.randrange(900))) for _ in range(12)]]
    docs = spark.createDataFrame([(i, t, 3000) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    token = relation_over("r_token", documents=docs)
    rows = lambda df: sorted(map(tuple, df.select("file_id", "seq", "word", "n", "begin").collect()))
    assert rows(positions.chunk_words(positions.word_chunks(docs, "doc_id"))) == rows(token)
    R = {"documents": docs, "r_occ": relation_over("r_occ", r_token=token)}.__getitem__
    some = lambda df: sorted(map(tuple, df.collect()))
    want = lookups.occurrence_at(catalog.occ(R), catalog.probes(R), 0, 1)
    assert want.count() and some(catalog.clicked(R)) == some(want)
    for name in ("j2_occurrence_at", "flagship_click"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [") == 1, name
