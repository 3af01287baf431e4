import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from skein.llm import sentencepiece_scan as S
from skein.session import table

TEXTS = ["", " ", "a", "  two  spaces ", "\n\nlines\n", "a" * 700, " " * 333, "ab" * 400, "the" * 300, "日本語のテキスト" * 30, "😀" * 60, "x\n\n  y" * 60, "Donaudampfschiff" * 40, "0123456789" * 50, "\x00\x01é�" * 20, "supercalifragilistic" * 30 + " " * 40 + "un" * 200]


@pytest.fixture(scope="module")
def sp():
    return SentencePieceProcessor(model_file=S.MODEL)


@pytest.mark.parametrize("size", [32, 77, 1000, 10**6])
def test_pieces_are_those_of_the_library(sp, size):
    rng = random.Random(1)
    more = ["".join(rng.choice("etaoin sh\n") for _ in range(900)) for _ in range(3)]
    for t in TEXTS + more:
        assert S.encode_text(t, size=size) == sp.encode(t), (t[:20], size)


def test_round_trip():
    for t in TEXTS:
        assert S.decode_ids(S.encode_text(t)) == t


def test_max_plus_is_associative():
    rng = np.random.default_rng(1)
    a, b, c = (np.where(rng.random(s) < 0.4, S.NEVER, rng.integers(-9, 9, s).astype(float)) for s in ((3, 4), (4, 5), (5, 2)))
    assert (S.max_plus(S.max_plus(a, b), c) == S.max_plus(a, S.max_plus(b, c))).all()


def test_combining_in_a_tree_settles_the_same_states(sp):
    p = S.pieces_of(S.MODEL)
    for t in ("the" * 900, "un" * 400 + " " * 300 + "able" * 300, "日本語" * 200 + "!?" * 300):
        t = S.prepared(t)
        matrices = [S.Chunk(p, *c).matrix() for c in S.chunks_of(p, t, 64)]
        assert len(matrices) > 10
        plain = S.border_states(matrices)
        assert all(S.tree_states(matrices, fan) == plain for fan in (2, 3, 7, 64))


def test_units_against_the_library(sp):
    p = S.Pieces(S.MODEL)
    rng = random.Random(5)
    units = {"".join(rng.choice("▁etaoinshrdlucé***$%%0123ßж日本一个😀\r.,'()x") for _ in range(rng.choice((1, 2, 5, 9, 20, 60)))) for _ in range(4000)} | {"ab" * 32, "a" * 64, "▁" * 64, "▁" * 40 + "the"}
    units = sorted({u for t in units for u in p.unit.findall(t)})
    assert len(units) > 3000
    want = [sp.encode("\n" + u.replace(S.SPACE, " "))[2:] for u in units]
    assert [np.frombuffer(x, np.int32).tolist() for x in p.merge_rows(units)] == want
    assert [np.frombuffer(p.scanned(u), np.int32).tolist() for u in units[::7]] == want[::7]
    long = ["the" * 500, "▁" * 700, "un" * 300 + "able"]
    assert [np.frombuffer(p.scanned(u), np.int32).tolist() for u in long] == [sp.encode("\n" + u.replace(S.SPACE, " "))[2:] for u in long]


def test_the_table_may_overflow(sp, monkeypatch):
    monkeypatch.setattr(S, "REMEMBERED", 5)
    p = S.Pieces(S.MODEL)
    texts = ["one two three four", "five six", "one two", ""]
    got = [np.frombuffer(p.units([S.prepared(t)])[0], np.int32).tolist() for t in texts]
    assert got == [sp.encode(t) for t in texts]


def test_giant_documents_in_spark(spark, sf, sp):
    docs = table(spark, sf, "documents")
    got = {r.doc_id: (r.ids, r.n_chunks) for r in S.encode(docs, size=700, fan=3).collect()}
    want = {r.doc_id: sp.encode(r.text) for r in docs.collect()}
    assert {d: i for d, (i, _) in got.items()} == want and max(n for _, n in got.values()) > 5


def test_query_round_trips(spark, sf):
    rows = S.op7_sentencepiece(spark, sf).collect()
    assert len(rows) == table(spark, sf, "documents").count() and all(r.roundtrip for r in rows)


def test_edge_cases(spark, sp):
    rows = [(1, None, 3, [1]), (None, "", 4, None), (2, "a  b ", 5, None), (2, "a  b ", 5, None), (9, "x" * 3000, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, ids array<int>")
    got = S.encode(docs, size=500)
    assert got.columns == ["doc_id", "row", "ids", "n_chunks"]
    assert sorted((r.doc_id or 0, len(r.ids)) for r in got.collect()) == sorted((i or 0, len(sp.encode(t or ""))) for i, t, *_ in rows)
    back = {r.doc_id: r.decoded for r in S.decode(got).collect()}
    assert back == {1: "", None: "", 2: "a  b ", 9: "x" * 3000}
    assert S.encode(docs.limit(0)).count() == 0
    assert S.decode(spark.createDataFrame([(1, None), (2, [5000, 300])], "k int, ids array<int>")).where("decoded is null").count() == 1
