"""Code relations derived from the driver's tables, so that both engines see the same input.

Each relation has one SQL text for Spark and DuckDB where the dialects agree, else one for each. The mapping is a test
scaffold: the tables hold no code facts. r_def's conditions make names that nothing defines: two orders of seven define
one, and none whose name leaves 4 by 9. r_root are the names a link starts from.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

# name -> text for both, or (Spark, DuckDB). {name} stands for a table or relation.
RELATIONS: dict[str, str | tuple[str, str]] = {
    "r_file": """SELECT doc_id AS file_id, concat('/', source, '/d', CAST(doc_id % 50 AS BIGINT), '/f', doc_id,
        CASE doc_id % 9 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' WHEN 2 THEN '.h' WHEN 3 THEN '.S' WHEN 4 THEN '.s' WHEN 5 THEN '.o' WHEN 6 THEN '.a' WHEN 7 THEN '.exe' ELSE '' END) AS path,
        CAST(doc_id % 3 AS INTEGER) AS mode, n_chars AS size FROM {documents}""",
    "r_token": (
        """SELECT file_id, seq, word, octet_length(word) AS n, CAST(coalesce(sum(octet_length(word) + 1) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
        FROM (SELECT doc_id AS file_id, posexplode(split(text, '[ \\n]', -1)) AS (seq, word) FROM {documents})""",
        """SELECT file_id, seq, word, strlen(word) AS n, CAST(coalesce(sum(strlen(word) + 1) OVER (PARTITION BY file_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begin
        FROM (SELECT file_id, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS seq FROM (SELECT doc_id AS file_id, string_split_regex(text, '[ \n]') AS ws FROM {documents}))""",
    ),
    "r_occ": """SELECT file_id, CAST(seq AS BIGINT) AS seq, begin, CAST(begin + n AS BIGINT) AS end_, word AS entity_id,
        CAST(CASE WHEN seq = 0 THEN 0 WHEN word LIKE '%.' THEN 3 WHEN n % 11 = 0 THEN 6 ELSE 5 END AS INTEGER) AS kind,
        CAST(n % 4 AS INTEGER) AS style, CAST(n % 26 AS INTEGER) AS entity_kind FROM {r_token} WHERE n > 0""",
    "r_include": """SELECT c_custkey AS includer, (c_custkey * 7 + 3) % n AS included FROM {customer}, (SELECT count(*) AS n FROM {customer}) x
        UNION SELECT c_custkey AS includer, m AS included FROM {customer} c, (SELECT c_nationkey AS k, min(c_custkey) AS m FROM {customer} GROUP BY c_nationkey) y WHERE c.c_nationkey = y.k
        UNION SELECT c_custkey AS includer, (c_custkey * 13 + 1) % n AS included FROM {customer}, (SELECT count(*) AS n FROM {customer}) z""",
    "r_def": """SELECT o_orderkey AS section_id, o_orderkey % n AS name, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 ELSE 2 END AS INTEGER) AS tier
        FROM {orders}, (SELECT count(*) AS n FROM {part}) x WHERE o_orderkey % 7 < 2 AND (o_orderkey % n) % 9 <> 4""",
    "r_req": """SELECT l_orderkey AS section_id, l_partkey AS name, bool_and(l_returnflag = 'R') AS weak FROM {lineitem} GROUP BY l_orderkey, l_partkey""",
    "r_root": "SELECT p_partkey AS name FROM {part} WHERE p_partkey IN (0, 10, 50)",
    "r_diag": """SELECT event_id, user_id AS unit_id, CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 ELSE 0 END AS INTEGER) AS severity, event_id AS seq, event_id % 5 = 0 AS is_link, props AS message FROM {events}""",
    "r_edit": "SELECT user_id AS file_id, event_id AS seq, event_id % 1000 AS offset_, event_id % 5 AS remove_, event_id % 7 AS insert_ FROM {events}",
    "r_change": "SELECT user_id AS unit_id, event_id AS seq, CAST(CASE WHEN event_type IN ('purchase', 'error') THEN -1 ELSE 1 END AS INTEGER) AS delta FROM {events}",
    "r_status": "SELECT user_id AS unit_id, event_id AS seq, CAST(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS INTEGER) AS status FROM {events}",
    "r_instance": "SELECT l_partkey AS occ_id, l_orderkey AS unit_id, l_returnflag = 'R' AS linked, CAST(l_linenumber % 4 AS INTEGER) AS style, l_suppkey AS entity_id FROM {lineitem}",
    "r_missing": "SELECT page_id AS unit_id, concat('d', CAST(page_id % 50 AS BIGINT), '/f', page_id * 4, CASE (page_id * 4) % 9 WHEN 0 THEN '.c' WHEN 1 THEN '.cpp' WHEN 2 THEN '.h' WHEN 3 THEN '.S' WHEN 4 THEN '.s' WHEN 5 THEN '.o' WHEN 6 THEN '.a' WHEN 7 THEN '.exe' ELSE '' END) AS header FROM {pages}",
    "r_scope": "SELECT conv_id AS unit_id, turn AS seq, CAST(CASE role WHEN 'user' THEN 1 ELSE -1 END AS INTEGER) AS d FROM {conversations}",
    "r_nm": """SELECT CAST(p_partkey % 50 AS VARCHAR(10)) AS stream, p_partkey AS seq, CASE WHEN p_size % 10 = 0 THEN concat('obj', p_partkey, '.o:')
        WHEN p_size % 3 = 0 THEN concat('         U ', p_name) WHEN p_size % 3 = 1 THEN concat('00000000 0000003', p_size % 7, ' ', substring('ABDTCVWtrwvuN', CAST(p_partkey % 13 AS INTEGER) + 1, 1), ' ', p_name) ELSE p_name END AS line FROM {part}""",
    "r_asm": """SELECT CAST(l_suppkey AS VARCHAR(10)) AS stream, l_orderkey * 10 + l_linenumber AS seq, CASE WHEN l_linenumber % 3 = 0 THEN 'note: nothing'
        ELSE concat('src/', l_returnflag, '.s:', l_linenumber + 1, ':', l_suppkey + 1, ': ', CASE WHEN l_linestatus = 'O' THEN 'error' ELSE 'warning' END, ': ', CASE WHEN l_partkey % 2 = 0 THEN 'invalid instruction mnemonic' ELSE 'unknown directive' END) END AS line FROM {lineitem}""",
    "r_event": """SELECT CAST(o_custkey % 40 AS VARCHAR(10)) AS stream, o_orderkey AS seq, CASE WHEN o_orderkey % 17 = 0 THEN concat('@/src/u', o_custkey, '.s') WHEN o_orderkey % 17 < 4 THEN concat('F', o_orderkey, ' f', o_custkey % 30)
        WHEN o_orderkey % 17 < 6 THEN concat('a', o_orderkey % 100, ':', o_orderkey % 10, ' s', o_custkey % 30) WHEN o_orderkey % 17 < 8 THEN concat('w f', o_custkey % 30) WHEN o_orderkey % 17 < 9 THEN concat('l s', o_custkey % 30) ELSE concat('u', o_orderkey, ' f', o_custkey % 30) END AS line FROM {orders}""",
    "r_flagword": """SELECT l_orderkey AS stream, l_linenumber AS pos, CASE l_partkey % 14 WHEN 0 THEN '-c' WHEN 1 THEN '-Iinc' WHEN 2 THEN '-I' WHEN 3 THEN '-mcpu=x' WHEN 4 THEN '-mfloat-abi=hard' WHEN 5 THEN '-x' WHEN 6 THEN '-DFOO'
        WHEN 7 THEN 'main.c' WHEN 8 THEN '-std=c99' WHEN 9 THEN '-MMD' WHEN 10 THEN '-isystem' WHEN 11 THEN '-Xlinker' WHEN 12 THEN '-o' ELSE '-Wall' END AS word FROM {lineitem}""",
    "r_linkword": """SELECT l_orderkey AS stream, l_linenumber AS pos, CASE l_partkey % 10 WHEN 0 THEN '-L' WHEN 1 THEN '-Llib' WHEN 2 THEN '-lm' WHEN 3 THEN '-l' WHEN 4 THEN '-(' WHEN 5 THEN '-)' WHEN 6 THEN '--defsym=a=1' WHEN 7 THEN '--gc-sections' WHEN 8 THEN 'x.o' ELSE 'y.a' END AS word FROM {lineitem}""",
    "r_rule": """SELECT n_nationkey AS rule_id, CASE n_nationkey % 4 WHEN 0 THEN '%.o' WHEN 1 THEN 'build/%.o' WHEN 2 THEN '%' ELSE '%.elf' END AS target,
        CASE n_nationkey % 5 WHEN 0 THEN '%.c' WHEN 1 THEN '%.cpp' WHEN 2 THEN 'f%.c' WHEN 3 THEN '%.S' ELSE '%.s' END AS prerequisite FROM {nation}""",
}


def spark_relation(spark: SparkSession, sf_dir: str, name: str, cache: dict | None = None) -> DataFrame:
    """A driver table or a derived relation, as a lazy DataFrame."""
    cache = {} if cache is None else cache
    if name in cache:
        return cache[name]
    if name in TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    else:
        text = RELATIONS[name]
        text = text if isinstance(text, str) else text[0]
        df = spark.sql(text, **{x: spark_relation(spark, sf_dir, x, cache) for x in set(re.findall(r"\{(\w+)\}", text))})
    cache[name] = df
    return df


def relation_over(name: str, **inputs: DataFrame) -> DataFrame:
    """A derived relation over other inputs than the driver's, its text the same."""
    text = RELATIONS[name]
    return next(iter(inputs.values())).sparkSession.sql(text if isinstance(text, str) else text[0], **inputs)


def duck_sql(query: str) -> str:
    """A DuckDB query over {relations}, with the relations it uses in front as common table expressions."""
    order: list[str] = []

    def need(text: str) -> None:
        for x in re.findall(r"\{(\w+)\}", text):
            if x not in TABLES and x not in order:
                t = RELATIONS[x]
                need(t if isinstance(t, str) else t[1])
                order.append(x)

    need(query)
    plain = lambda t: re.sub(r"\{(\w+)\}", r"\1", t)
    ctes = []
    for x in order:
        t = RELATIONS[x]
        ctes.append(f"{x} AS MATERIALIZED ({plain(t if isinstance(t, str) else t[1])})")
    body = plain(query).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join(ctes) + ", " + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + body[len("WITH "):]
    return "WITH " + ", ".join(ctes) + " " + body
