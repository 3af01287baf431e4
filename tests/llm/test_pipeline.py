"""The pipeline against its stages in plain Python, and the entry without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

from sentencepiece import SentencePieceProcessor

import corpus_pipeline as C
from skein.llm import decontaminate as D
from skein.llm import quality as Q
from skein.llm.sentencepiece_scan import MODEL
from skein.session import table
from tests.llm.test_secrets import brute

REPO = Path(__file__).resolve().parents[2]


def heads_of(texts):
    """The smallest id of each component of five-word Jaccard similarity of 0.8 or more, over all pairs."""
    sets = {}
    for d, text in texts.items():
        words = (text or "").encode().lower().split()
        sets[d] = {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}
    ids, comp = sorted(sets), {d: d for d in sets}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both) and comp[a] != comp[b]:
                low, high = sorted((comp[a], comp[b]))
                comp = {d: low if c == high else c for d, c in comp.items()}
    return {d for d in ids if comp[d] == d}


def test_run_against_plain_python(spark, sf):
    docs = {r.doc_id: r for r in table(spark, sf, "documents").collect()}
    scorer = Q.Scorer(*Q.fit(table(spark, sf, "documents"), table(spark, sf, "labels")))
    docs = {i: r for i, r in docs.items() if scorer(r.text or "") >= 0}
    docs = {i: docs[i] for i in heads_of({i: r.text for i, r in docs.items()})}
    items = [D.passages_of(r.text) for r in table(spark, sf, "benchmark").collect()]

    def leaks(text):
        words = [w for w in map(D.normal, (text or "").split()) if w]
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        return any(sum(tuple(p[i : i + 5]) in grams for i in range(len(p) - 4)) >= 0.8 * (len(p) - 4) for ps in items for p in ps)

    docs = {i: r for i, r in docs.items() if not leaks(r.text)}
    got = {r.doc_id: r for r in C.run(spark, sf).collect()}
    assert set(got) == set(docs)
    sp = SentencePieceProcessor(model_file=MODEL)
    for i, r in docs.items():
        if not any(brute(r.text)[:3]):
            assert got[i].ids == sp.encode(r.text) and got[i].n_tokens == len(got[i].ids)
        else:
            assert "[SECRET]" in sp.decode(got[i].ids) or "[EXAMPLE]" in sp.decode(got[i].ids)


def test_stages(spark, sf):
    assert [n for n, _ in C.STAGES] == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "sentencepiece_encode"]
    docs = table(spark, sf, "documents")
    for _, stage in C.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == C.COLUMNS
        assert stage(spark, docs.limit(0), sf).count() == 0
    assert C.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_the_rest_works_without_the_folders(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(REPO, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'flagship_click' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, timeout=120, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith(("JAVA", "PY_", "PATH"))})
    code = code.replace("and 'pipeline' not in q and not any(k.startswith('op') for k in q)", "")
    subprocess.run([sys.executable, "-c", code], cwd=REPO, check=True, timeout=120)


def test_near_dedup_tells_rows_apart_by_id_and_words(spark):
    one, two = "one two three four five six", "seven eight nine ten eleven"
    rows = [(5, one), (5, two), (5, one), (7, one + " "), (8, "ONE two three four five six"), (None, one), (None, one), (9, None), (10, ""), (11, " "), (12, "a b"), (13, "b a"), (14, "A  b")]
    df = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in C.simhash_near_dedup(spark, df, "").collect()), key=str)
    assert got == sorted([(5, one), (5, two), (None, one), (None, one), (9, None), (12, "a b"), (13, "b a")], key=str)


def test_stages_in_a_chain_with_odd_rows(spark, sf):
    docs = table(spark, sf, "documents")
    odd = spark.createDataFrame([(None, "null id of a text with some words in it", "en", None, None), (1, None, None, None, None), (1, "", "en", "s", 0), (2, "password=hunter22 " * 3, "en", "s", 5), (2, "password=hunter22 " * 3, "en", "s", 5)], docs.schema)
    rows = docs.unionByName(odd)
    for name, stage in C.STAGES:
        rows = C.materialize(stage(spark, rows, sf), name)
        assert rows.count() > 0
        if name != "sentencepiece_encode":
            assert rows.columns == C.COLUMNS
    assert rows.where("doc_id is not null").groupBy("doc_id", "n_tokens").count().where("count > 1").count() <= 1
