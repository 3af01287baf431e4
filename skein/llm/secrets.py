"""Secret scan by corpus-wide ownership frequency, with DataFrame functions only.

Every candidate credential is hashed, and the hashes are counted over the corpus by distinct repositories and owners. A
hash that several owners or many repositories hold is a copied example; any other looks live. The base kinds are always
reported; vendor-format tokens are added where the counts speak for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import materialize

# The contract's patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
# Token formats that vendors document publicly; the method adds these.
VENDOR = r"gh[pousr]_[A-Za-z0-9]{20,}|xox[abeprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,}|sk_live_[A-Za-z0-9]{16,}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"

KINDS = ("assign", "access", "hex", "vendor")
BASE = 3
#: A hash that this many owners hold is a copied example; so is one that this many repositories hold, whoever owns them.
COPIED_OWNERS, COPIED_REPOS = 3, 10


PIECES = "array<struct<kind:int,gap:int,len:int,hash:string>>"


def _pieces(text: Column, kind: int, pattern: str, value_group: int = 0, least: int = 0) -> Column:
    """Array of (kind, gap, len, hash) of a pattern's matches: how much text stands before each, how long it is, and the
    hash of the secret itself (null for matches that are too short). Each match costs its own length, whatever their number.
    """
    pat = F.lit(pattern)
    hits = F.regexp_extract_all(text, pat, F.lit(0))
    values = F.regexp_extract_all(text, pat, F.lit(value_group)) if value_group else hits
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
    rows = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(hits, F.length).alias("len"), values.alias("value"))
    secret = lambda x: F.when(F.length(x["value"]) >= least, F.sha2(x["value"].cast("binary"), 256))
    found = F.transform(rows, lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["len"].alias("len"), secret(x).alias("hash")))
    return F.coalesce(F.when(text.rlike(pattern), found), F.array()).cast(PIECES)


def candidate_pieces(text: Column) -> Column:
    """The pieces of all kinds of a text (null: none), kind by kind, in text order."""
    t = F.coalesce(text, F.lit(""))
    return F.concat(_pieces(t, 0, ASSIGN, 2, ASSIGN_LEAST), _pieces(t, 1, ACCESS), _pieces(t, 2, HEX), _pieces(t, 3, VENDOR))


def candidates(scanned: DataFrame) -> DataFrame:
    """scanned (row, repo, owner, pieces) -> (row, repo, owner, kind, start, end, hash), in code points.

    Pieces between matches and matches alternate, so places are running sums of their lengths.
    """
    one = scanned.select("row", "repo", "owner", F.posexplode("pieces").alias("at", "p")).select("row", "repo", "owner", "at", "p.*")
    w = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("gap") + F.col("len")).over(w).cast("int")
    placed = one.withColumn("end", end).withColumn("start", F.col("end") - F.col("len"))
    return placed.where("hash is not null").select("row", "repo", "owner", "kind", "start", "end", "hash")


def ownership(cands: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) for candidates (hash, repo, owner); a null repo or owner counts as one of its own kind.

    Counted in three groupings, each with map-side combine, so a hash, repository or owner with a third of all rows
    reaches a task as one row per upstream task.
    """
    name = lambda c: F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    pairs = cands.select("hash", name("repo").alias("repo"), name("owner").alias("owner")).distinct()
    by_repo = pairs.groupBy("hash", "repo").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_repos"))
    by_owner = pairs.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count("one").alias("n_owners"))
    return by_repo.join(by_owner.withColumnRenamed("hash", "owned"), F.col("hash") == F.col("owned")).select("hash", "n_repos", "n_owners")


def judged(scanned: DataFrame, copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """scanned (row, repo, owner, pieces) -> (row, kind, start, end, live) of all findings; vendor tokens that are copied
    examples are none.

    A secret is a copied example if `copied_owners` owners or `copied_repos` repositories hold it, else it looks live.
    Hashes of that many repositories are few and are joined by broadcast where Spark knows them to be small; a hash with
    a third of all findings is split by the skew join otherwise.
    """
    cands = materialize(candidates(scanned), "candidates")
    copied = ownership(cands).where((F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)).select(F.col("hash").alias("copied"))
    held = cands.join(materialize(copied, "copied"), F.col("hash") == F.col("copied"), "left")
    live = F.col("copied").isNull()
    return held.where((F.col("kind") < BASE) | live).select("row", "kind", "start", "end", live.alias("live"))


def _joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """One row per row of docs: id, n_assign, n_access, n_hex, n_vendor, n_live, base_sha256 and spans.

    spans lists kind:start:end of all findings by start, then kind (code points, end exclusive); n_live counts the
    findings whose secret looks live: fewer than `copied_owners` owners and `copied_repos` repositories hold it. Defined
    cases: a null or empty text has no spans, the digest of the empty string and an empty span list; null ids,
    repositories and owners are allowed; equal rows each give a row; other columns are ignored; an empty table gives an
    empty result. The work grows with a text's length and findings alone.
    """
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(repo_col).cast("string").alias("repo"),
        F.col(owner_col).cast("string").alias("owner"),
        candidate_pieces(F.col(text_col).cast("string")).alias("pieces"),
        F.monotonically_increasing_id().alias("row"),
    )
    scanned = materialize(rows, "pieces")
    some = scanned.where(F.size("pieces") > 0)
    found = judged(some, copied_owners, copied_repos).groupBy(F.col("row").alias("found_row")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found"))
    count = lambda spans, k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")
    cols = lambda spans: [
        F.col("id").alias(id_col),
        count(spans, 0).alias("n_assign"),
        count(spans, 1).alias("n_access"),
        count(spans, 2).alias("n_hex"),
        count(spans, 3).alias("n_vendor"),
        F.size(F.filter(spans, lambda s: s["live"])).cast("long").alias("n_live"),
        F.sha2(_joined(F.filter(spans, lambda s: s["kind"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    ]
    none = F.array().cast("array<struct<start:int,kind:int,end:int,live:boolean>>")
    hit = some.select("id", "row").join(found, F.col("row") == F.col("found_row"), "left").select(*cols(F.coalesce("found", none)))
    return hit.unionByName(scanned.where(F.size("pieces") == 0).select(*cols(none)))


#: Code points of a slice: a finding costs two slices at most, however long its text.
SLICE = 4096


def redact_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS, copied_repos: int = COPIED_REPOS) -> DataFrame:
    """docs with every finding cut out of the text: [SECRET] for live-looking ones, [EXAMPLE] for copied ones.

    Overlapping findings are cut as one (the first one's tag stands). n_chars, where docs has it, follows the new text.
    Rows without findings pass through the plan untouched. Nulls, empty texts and repeats behave as in scan_secrets.
    """
    names = docs.columns
    pieces = candidate_pieces(F.col(f"`{text_col}`").cast("string"))
    scanned = materialize(docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("doc"), pieces.alias("pieces"), F.monotonically_increasing_id().alias("row")), "scanned")
    untouched = scanned.where(F.size("pieces") == 0).select("doc.*")
    hit = scanned.where(F.size("pieces") > 0)
    slim = hit.select("row", F.col("doc")[repo_col].cast("string").alias("repo"), F.col("doc")[owner_col].cast("string").alias("owner"), "pieces")
    # a finding that begins before the farthest end so far belongs to the cut before it
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = judged(slim, copied_owners, copied_repos).withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    tag = F.when(F.col("live"), F.lit("[SECRET]")).otherwise(F.lit("[EXAMPLE]"))
    cut = F.when(F.col("start") >= F.col("reach"), F.struct("start", "reach", tag.alias("tag")))
    cuts = spans.groupBy(F.col("row").alias("found_row")).agg(F.array_sort(F.collect_list(cut)).alias("cuts"), F.max("end").alias("last"))
    slices = F.regexp_extract_all(F.col("doc")[text_col], F.lit("(?s).{1,%d}" % SLICE), F.lit(0))
    done = hit.join(cuts, F.col("row") == F.col("found_row"), "left").withColumn("slices", slices)

    def between(a: Column, b: Column) -> Column:
        """The text from a to b, out of the slices it touches."""
        i, j = (a / SLICE).cast("int"), (b / SLICE).cast("int")
        piece = lambda k: F.coalesce(F.get("slices", k), F.lit(""))
        inner = F.array_join(F.slice("slices", i + 2, F.greatest(j - i - 1, F.lit(0))), "")
        whole = F.concat(F.substring(piece(i), a - i * SLICE + 1, F.lit(SLICE)), inner, F.substring(piece(j), F.lit(1), b - j * SLICE))
        return F.when(i == j, F.substring(piece(i), a - i * SLICE + 1, b - a)).otherwise(whole)

    kept = F.array_join(F.transform("cuts", lambda x: F.concat(between(x["reach"], x["start"]), x["tag"])), "")
    text = F.col("doc")[text_col]
    clean = F.when(F.col("cuts").isNull(), text).otherwise(F.concat(kept, between(F.col("last"), F.length(text))))
    done = done.withColumn("clean", clean)
    new = {text_col: F.col("clean")} | ({"n_chars": F.length("clean").cast(docs.schema["n_chars"].dataType)} if "n_chars" in names else {})
    done = done.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in names])
    return untouched.unionByName(done)


def op8_secrets(spark, sf_dir: str) -> DataFrame:
    from skein.session import table

    return scan_secrets(table(spark, sf_dir, "documents"))


def _duck_kind(kind: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return f"SELECT r, {kind} AS kind, regexp_extract_all(t, '{p}', 0) AS hits, regexp_extract_all(t, '{p}', {group}) AS vals, regexp_split_to_array(t, '{p}') AS gaps FROM d WHERE regexp_matches(t, '{p}')"


OP8_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, coalesce(concat('s', source), '') AS owner, coalesce(CAST(doc_id AS VARCHAR), '') AS repo FROM documents),
s AS ({" UNION ALL ".join(_duck_kind(k, p, g) for k, p, g in ((0, ASSIGN, 2), (1, ACCESS, 0), (2, HEX, 0), (3, VENDOR, 0)))}),
e AS (SELECT r, kind, hits, vals, gaps, unnest(range(1, len(hits) + 1)) AS i FROM s),
x AS (SELECT r, kind, vals[i] AS v, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS BIGINT) AS a, length(hits[i]) AS n FROM e),
f AS (SELECT x.*, d.owner, d.repo, sha256(v) AS h FROM x JOIN d ON x.r = d.r WHERE kind > 0 OR length(v) >= {ASSIGN_LEAST}),
o AS (SELECT h, count(DISTINCT owner) < {COPIED_OWNERS} AND count(DISTINCT repo) < {COPIED_REPOS} AS live FROM f GROUP BY h),
g AS (SELECT f.r, f.kind, f.a, concat({list(KINDS)}[f.kind + 1], ':', f.a, ':', f.a + f.n) AS span, o.live FROM f JOIN o ON f.h = o.h),
m AS (SELECT r, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3 AND live) AS n_vendor, count(*) FILTER (live) AS n_live,
  coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (kind < {BASE}), '') AS base, coalesce(string_agg(span, ',' ORDER BY a, kind) FILTER (kind < {BASE} OR live), '') AS spans FROM g GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_vendor, 0) AS n_vendor, coalesce(n_live, 0) AS n_live,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN m ON d.r = m.r
"""
