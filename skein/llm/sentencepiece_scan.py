"""SentencePiece encoding and decoding, with a max-plus scan over the chunks of giant documents.

A text is a path of pieces: neighbouring pieces may follow each other (weight 0) if byte-pair merging of their joint text
gives just these two, and may not (weight minus infinity) otherwise; the only path from end to end is the encoding. For a
document of many chunks, each chunk alone yields a matrix from the pieces that may cross its left border to those that
may cross its right border. Matrices are combined associatively in max-plus algebra, FAN at a time in a tree; on the way
back down each product's states settle those of its parts, down to the piece at every border, and each chunk is then
traced back by itself.

Between two letters that no piece has side by side no piece crosses, so a text falls into units there. Units are merged
all at once, as rows of a matrix, and remembered in a bounded table. The model's library only reads the model.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.common import materialize, strings

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Characters of a chunk; longer documents are split.
CHUNK = 32_768
#: Units whose pieces are remembered, and the longest that are merged in rows.
REMEMBERED, ROW = 300_000, 64
#: Matrices combined in one step.
FAN = 64
SPACE = "▁"
NEVER = -np.inf


def unit_pattern(pieces: Iterable[str]) -> re.Pattern:
    """Spaces and what follows them, up to two letters that no piece has side by side. Letters that pieces join, in
    however many steps, are of one class; pieces have spaces in front alone."""
    up: dict[str, str] = {}

    def find(x: str) -> str:
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for q in pieces:
        bare = q.strip(SPACE)
        if SPACE in bare or (bare and q.endswith(SPACE)):
            raise ValueError(f"a space inside the piece {q!r}")
        for a, b in zip(bare, bare[1:], strict=False):
            up[find(a)] = find(b)
    classes: dict[str, list[str]] = {}
    for x in sorted(up):
        classes.setdefault(find(x), []).append(x)
    runs = ["[" + re.escape("".join(c)) + "]+" for c in classes.values() if len(c) > 1]
    return re.compile(f"{SPACE}*(?:{'|'.join([*runs, f'[^{SPACE}]'])})|{SPACE}+", re.DOTALL)


class Pieces:
    """A byte-pair model with byte fallback, as read from its file."""

    def __init__(self, model: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.raw: list[bytes] = []  # what each id stands for
        self.id_of: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[3:5], 16)] = i
                self.raw.append(bytes([int(p[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i):
                self.raw.append(b"")
            else:
                self.raw.append(p.replace(SPACE, " ").encode())
                self.id_of[p], self.score[p] = i, sp.get_score(i)
        self.longest = max(map(len, self.id_of))
        self.unit = unit_pattern(self.id_of)
        self.known: dict[str, bytes] = {}
        self.follows = lru_cache(1 << 17)(self._follows)
        self._tabulate()

    def _tabulate(self) -> None:
        """Arrays for merging in rows: a symbol for each piece and letter, and what each pair of symbols becomes."""
        symbol = {q: i for i, q in enumerate([*self.id_of, *sorted({c for q in self.id_of for c in q} - self.id_of.keys())])}
        self.letter = np.full(0x110000, -1, np.int32)
        for q, i in symbol.items():
            if len(q) == 1:
                self.letter[ord(q)] = i
        self.piece = np.full(len(symbol), -1, np.int32)
        for q, i in self.id_of.items():
            self.piece[symbol[q]] = i
        self.step = len(symbol) + 1
        pairs = sorted((symbol[q[:i]] * self.step + symbol[q[i:]], symbol[q], self.score[q]) for q in self.id_of for i in range(1, len(q)) if q[:i] in symbol and q[i:] in symbol)
        self.pair = np.array([x for x, _, _ in pairs], np.int64)
        self.becomes = np.array([x for _, x, _ in pairs], np.int32)
        self.gain = np.array([x for *_, x in pairs], np.float32)

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, symbol) of joining neighbours; minus infinity where they don't join."""
        key = np.where((a < 0) | (b < 0), -1, a.astype(np.int64) * self.step + b)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        hit = self.pair[at] == key
        return np.where(hit, self.gain[at], np.float32(NEVER)), self.becomes[at]

    def merge_rows(self, units: list[str]) -> list[bytes]:
        """Ids (packed) of units of at most ROW letters: in every row the best-scored pair joins first, the leftmost of
        equals, until none is left."""
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        codes = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        width = int(sizes.max(initial=1))
        inside = np.arange(width)[None, :] < sizes[:, None]
        letters = np.zeros((len(units), width), np.uint32)
        letters[inside] = codes
        s = np.full((len(units), width + 1), -1, np.int32)  # a column more, so that shifting left brings in an end
        s[:, :width][inside] = self.letter[codes]
        strange = ((s[:, :width] < 0) & inside).any(1)
        out = np.full((len(units), width), -1, np.int32)
        rows = np.flatnonzero(~strange)
        s = s[rows]
        gain, to = self._pairs(s[:, :-1], s[:, 1:])
        columns = np.arange(width + 1)
        while len(rows):
            j = gain.argmax(1)
            live = gain[np.arange(len(rows)), j] > NEVER
            if not live.all():
                out[rows[~live]] = s[~live, :width]
                rows, s, gain, to, j = rows[live], s[live], gain[live], to[live], j[live]
                if not len(rows):
                    break
            n = np.arange(len(rows))
            s[n, j] = to[n, j]
            # what stands behind the joined pair moves up
            from_ = np.minimum(columns[None, :] + (columns[None, :] > j[:, None]), width)
            s = np.take_along_axis(s, from_, 1)
            s[:, width] = -1
            gain, to = (np.take_along_axis(x, np.minimum(from_[:, :width], width - 1), 1) for x in (gain, to))
            gain[:, width - 1] = NEVER
            for k in (j - 1, j):
                ok = np.flatnonzero((k >= 0) & (k < width))
                gain[ok, k[ok]], to[ok, k[ok]] = self._pairs(s[ok, k[ok]], s[ok, k[ok] + 1])
        length = (out >= 0).sum(1)
        ids = np.where(out >= 0, self.piece[np.maximum(out, 0)], -1).astype(np.int32)
        # a letter that is no piece itself stands for its bytes, as a strange one does
        odd = strange | ((out >= 0) & (ids < 0)).any(1)
        flat = ids[out >= 0].tobytes()
        ends = np.cumsum(length) * 4
        packed = [flat[e - 4 * n : e] for n, e in zip(length.tolist(), ends.tolist(), strict=True)]
        for i in np.flatnonzero(odd):
            packed[i] = np.array([x for q in self.merged(units[i]) for x in self.ids(q)], np.int32).tobytes()
        return packed

    def merged(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best-scored pair first, the leftmost of equals."""
        s = list(text)
        while len(s) > 1:
            best = max(((self.score[a + b], -i) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if a + b in self.score), default=None)
            if best is None:
                break
            i = -best[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        return s

    def _follows(self, a: str, b: str) -> bool:
        return self.merged(a + b) == ([a, b] if a else [b])

    def ids(self, piece: str) -> list[int]:
        i = self.id_of.get(piece)
        return [i] if i is not None else [self.byte[x] for x in piece.encode("utf-8", "surrogatepass")]

    def scanned(self, unit: str) -> bytes:
        """Ids (packed) of a long unit, as the only path of pieces through it."""
        ends, before = forward(self, unit, [(0, 0)], len(unit))
        return np.array(path_ids(self, unit, before, (next(iter(ends[len(unit)])), len(unit)), (0, 0)), np.int32).tobytes()

    def learn(self, units: set[str]) -> None:
        """Put the ids of units, which no piece crosses, into the table."""
        if len(self.known) + len(units) > REMEMBERED:
            self.known.clear()
        some = sorted((u for u in units if u not in self.known), key=len)
        short = [u for u in some if len(u) <= ROW]
        for i in range(0, len(short), 8192):
            part = short[i : i + 8192]
            self.known.update(zip(part, self.merge_rows(part), strict=True))
        self.known.update((u, self.scanned(u)) for u in some[len(short) :])

    def units(self, texts: list[str]) -> list[bytes]:
        """Ids (packed) of texts between two places that no piece crosses."""
        parts = [self.unit.findall(t) for t in texts]
        known = self.known
        try:
            return [b"".join([known[u] for u in us]) for us in parts]
        except KeyError:
            self.learn({u for us in parts for u in us})
            known = self.known
            return [b"".join([known[u] for u in us]) for us in parts]


@lru_cache(4)
def pieces_of(model: str) -> Pieces:
    """The model at a path; where a worker doesn't have it, the copy that hand_out() sent."""
    return Pieces(model if os.path.exists(model) else SparkFiles.get(os.path.basename(model)))


def hand_out(spark: SparkSession, model: str) -> None:
    """Have the model's file sent to the executors, once a context."""
    sc = spark.sparkContext
    sent = hand_out.sent = getattr(hand_out, "sent", set())
    if (sc.applicationId, model) not in sent:
        sc.addFile(model)
        sent.add((sc.applicationId, model))


def prepared(text: str) -> str:
    """A text as pieces see it: spaces as marks, and one more in front. Empty stays empty."""
    return SPACE + text.replace(" ", SPACE) if text else ""


Node = tuple[int, int]  # a piece as a range of the text; an empty range at a fixed border


def forward(p: Pieces, text: str, states: list[Node], upto: int) -> tuple[dict[int, dict[int, int]], dict[Node, list[Node]]]:
    """Pieces reachable from the states: end -> start -> bits of the states, and each piece's predecessors. Pieces that
    end at or beyond upto are not continued."""
    ends: dict[int, dict[int, int]] = {}
    before: dict[Node, list[Node]] = {}
    for i, (a, b) in enumerate(states):
        at = ends.setdefault(b, {})
        at[a] = at.get(a, 0) | 1 << i
    for b in range(min((b for _, b in states), default=upto), upto):
        here = ends.get(b)
        if not here:
            continue
        for n in range(1, min(p.longest, len(text) - b) + 1):
            q = text[b : b + n]
            if n > 1 and q not in p.score:
                continue
            bits, ok = 0, []
            for a, m in here.items():
                if p.follows(text[a:b], q):
                    bits |= m
                    ok.append((a, b))
            if bits:
                at = ends.setdefault(b + n, {})
                at[b] = at.get(b, 0) | bits
                before[b, b + n] = ok
    return ends, before


def path_ids(p: Pieces, text: str, before: dict[Node, list[Node]], node: Node, start: Node) -> list[int]:
    """Ids of the pieces after start up to and with node."""
    back: list[Node] = []
    while node != start:
        back.append(node)
        node = before[node][0]
    return [i for a, b in reversed(back) for i in p.ids(text[a:b])]


def borders(p: Pieces, text: str, c: int) -> list[Node]:
    """Pieces that may cross or end at a place: all ranges of the vocabulary, and single characters."""
    return [(a, b) for a in range(max(0, c - p.longest), c) for b in range(c, min(len(text), a + p.longest) + 1) if b == a + 1 or text[a:b] in p.score]


class Chunk:
    """A slice of a prepared text with margins of `longest` characters where the text goes on; places are of the slice."""

    def __init__(self, p: Pieces, text: str, start: int, end: int, first: bool, last: bool):
        self.p, self.text, self.start, self.end = p, text, start, end
        fixed = [m.start() for m in p.unit.finditer(text) if m.start() or first]
        self.inner = [u for u in fixed if start <= u < end]
        self.ins = [(0, 0)] if first else borders(p, text, start)
        self.outs = [(len(text), len(text))] if last else borders(p, text, end)
        self.last = last

    def _arrive(self, ends: dict[int, dict[int, int]], out: Node) -> int:
        if self.last:  # any piece that ends with the text
            bits = 0
            for m in ends.get(out[1], {}).values():
                bits |= m
            return bits
        return ends.get(out[1], {}).get(out[0], 0)

    def matrix(self) -> np.ndarray:
        """Max-plus transfer matrix, in-states x out-states."""
        out = np.full((len(self.ins), len(self.outs)), NEVER)
        if self.inner:
            u0, u1 = self.inner[0], self.inner[-1]
            head = 0
            for m in forward(self.p, self.text, self.ins, u0)[0].get(u0, {}).values():
                head |= m
            tail = forward(self.p, self.text, [(u1, u1)], self.end)[0]
            into = np.array([0.0 if head >> i & 1 else NEVER for i in range(len(self.ins))])
            onto = np.array([0.0 if self._arrive(tail, o) else NEVER for o in self.outs])
            return into[:, None] + onto[None, :]
        ends = forward(self.p, self.text, self.ins, self.end)[0]
        for j, o in enumerate(self.outs):
            bits = self._arrive(ends, o)
            for i in range(len(self.ins)):
                if bits >> i & 1:
                    out[i, j] = 0.0
        return out

    def _path(self, state: Node, upto: int, goal: Node | None) -> list[int]:
        """Ids of the pieces after the state up to the goal, or to any piece that ends at upto."""
        ends, before = forward(self.p, self.text, [state], upto)
        node = goal if goal is not None else next(((a, upto) for a in ends.get(upto, {})), state)
        return path_ids(self.p, self.text, before, node, state)

    def trace(self, i: int, j: int) -> bytes:
        """Ids (packed) of the pieces after in-state i up to and with out-state j."""
        goal = None if self.last else self.outs[j]
        upto = len(self.text) if self.last else self.end
        if not self.inner:
            return np.array(self._path(self.ins[i], upto, goal), np.int32).tobytes()
        u0, u1 = self.inner[0], self.inner[-1]
        state = self.ins[i]
        head = [] if state[1] == u0 else self._path(state, u0, None)
        return np.array(head, np.int32).tobytes() + self.p.units([self.text[u0:u1]])[0] + np.array(self._path((u1, u1), upto, goal), np.int32).tobytes()


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; associative, so chunks may be combined in any grouping."""
    return (a[:, :, None] + b[None, :, :]).max(1) if a.size and b.size else np.full((a.shape[0], b.shape[1]), NEVER)


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The product of neighbouring chunks' matrices, halving their number at each step."""
    while len(matrices) > 1:
        matrices = [max_plus(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def border_states(matrices: list[np.ndarray], start: int | None = None, goal: int | None = None) -> list[tuple[int, int]]:
    """(in-state, out-state) of each of some neighbouring chunks on the best path from the first one's in-state `start` to
    the last one's out-state `goal`; None: the best."""
    on = np.zeros(matrices[-1].shape[1])
    if goal is not None:
        on[:] = NEVER
        on[goal] = 0
    after = [on]
    for m in reversed(matrices):
        after.append((m + after[-1][None, :]).max(1))
    after.reverse()
    # states are chosen left to right, so that neighbours agree where several would do
    out, i = [], int(after[0].argmax()) if start is None else start
    for k, m in enumerate(matrices):
        total = m[i] + after[k + 1]
        j = int(total.argmax())
        if total[j] == NEVER:
            raise ValueError("no path of pieces leads through the text")
        out.append((i, j))
        i = j
    return out


def tree_states(matrices: list[np.ndarray], fan: int = FAN) -> list[tuple[int, int]]:
    """border_states of many chunks: products of fan at a time, up to one; then each product's states settle its parts'."""
    levels = [matrices]
    while len(levels[-1]) > fan:
        levels.append([product(levels[-1][i : i + fan]) for i in range(0, len(levels[-1]), fan)])
    states = border_states(levels[-1])
    for level in reversed(levels[:-1]):
        states = [s for g, (i, j) in enumerate(states) for s in border_states(level[g * fan : (g + 1) * fan], i, j)]
    return states


def chunks_of(p: Pieces, text: str, size: int) -> Iterator[tuple[str, int, int, bool, bool]]:
    """Slices (text with margins, start, end, first, last) of a prepared text."""
    n = max(1, -(-len(text) // size))
    for k in range(n):
        a, b = k * size, min(len(text), (k + 1) * size)
        low, high = max(0, a - p.longest), min(len(text), b + p.longest)
        yield text[low:high], a - low, b - low, k == 0, k == n - 1


def encode_text(text: str | None, model: str = MODEL, size: int = CHUNK) -> list[int]:
    """One text's ids by the scan, on one machine."""
    p, t = pieces_of(model), prepared(text or "")
    if not t:
        return []
    if len(t) <= size:
        return np.frombuffer(p.units([t])[0], np.int32).tolist()
    chunks = [Chunk(p, *c) for c in chunks_of(p, t, max(size, 2 * p.longest))]
    states = tree_states([c.matrix() for c in chunks])
    return np.frombuffer(b"".join(c.trace(*s) for c, s in zip(chunks, states, strict=True)), np.int32).tolist()


def decode_ids(ids: list[int], model: str = MODEL) -> str:
    raw = pieces_of(model).raw
    text = b"".join([raw[i] for i in ids]).decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _id_lists(packed: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in packed), np.int64, len(packed))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.frombuffer(b"".join(packed), np.int32)))


def encode(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, model: str = MODEL, size: int = CHUNK, fan: int = FAN) -> DataFrame:
    """docs' columns `keep` (all but the text, unless named) with ids, the piece ids of the whole text, and n_chunks.

    Texts of up to `size` characters are one chunk and are encoded in place, without a shuffle; the chunks of longer ones
    are dealt out, so one giant document takes as many tasks as it has chunks. The pieces are those of the model's own
    library. Defined cases: null and empty texts have no ids; the mark U+2581 counts as a space; equal rows each give a
    row; nulls in other columns pass; columns of docs named ids or n_chunks give way to the results; an empty table gives
    an empty result.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (text_col, "ids", "n_chunks")]
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text)
    kept = T.StructType([rows.schema[c] for c in keep])
    out_schema = T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_chunks", T.IntegerType())])
    giant = F.length("__text") > size - 1
    hand_out(docs.sparkSession, model)

    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                texts = [prepared(x) for x in strings(some.column(some.num_columns - 1))]
                packed = p.units(texts)
                ones = pa.array(np.array([int(bool(x)) for x in texts], np.int32))
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], _id_lists(packed), ones], schema=pa.schema([*list(some.schema)[:-1], pa.field("ids", pa.list_(pa.int32())), pa.field("n_chunks", pa.int32())]))

    plain = rows.where(~giant).mapInArrow(small, out_schema)
    # row numbers are fixed by writing the chunks out
    listed = rows.where(giant).withColumn("__row", F.monotonically_increasing_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in batches:
            for row, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for k, (piece, a, e, first, last) in enumerate(chunks_of(p, prepared(t), size)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "k": k, "piece": piece, "start": a, "end": e, "first": first, "last": last}])

    spark = docs.sparkSession
    listed = materialize(listed, "giants")
    if listed.isEmpty():
        return plain
    chunks = materialize(listed.select("__row", "__text").mapInArrow(cut, "row long, k long, piece string, start long, end long, first boolean, last boolean"), "chunks")
    slots = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunks.repartition(slots, "row", "k")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in batches:
            for r in b.to_pylist():
                m = Chunk(p, r["piece"], r["start"], r["end"], r["first"], r["last"]).matrix()
                yield pa.RecordBatch.from_pylist([{"row": r["row"], "k": r["k"], "n_in": m.shape[0], "m": m.astype(np.float32).tobytes()}])

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        """Rows sorted by row and k -> those of each row and k // fan together: fan small matrices at most."""
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and (r["row"], r["k"] // fan) != (held[0]["row"], held[0]["k"] // fan):
                    yield held
                    held = []
                held.append(r | {"m": np.frombuffer(r["m"], np.float32).reshape(r["n_in"], -1)})
        if held:
            yield held

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            m = product([r["m"] for r in g])
            yield pa.RecordBatch.from_pylist([{"row": g[0]["row"], "k": g[0]["k"] // fan, "n_in": m.shape[0], "m": m.astype(np.float32).tobytes()}])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches):
            states = border_states([r["m"] for r in g], g[0]["start"], g[0]["goal"])
            yield pa.RecordBatch.from_pydict({"s_row": [r["row"] for r in g], "s_k": [r["k"] for r in g], "i": [i for i, _ in states], "j": [j for _, j in states]})

    def together(df: DataFrame) -> DataFrame:
        return df.repartition(slots, "row", (F.col("k") / fan).cast("long")).sortWithinPartitions("row", "k")

    m_schema, s_schema = "row long, k long, n_in long, m binary", "s_row long, s_k long, i long, j long"
    levels = [materialize(chunks.mapInArrow(matrices, m_schema), "matrices")]
    n = chunks.agg(F.max("k")).first()[0] + 1
    while n > fan:
        levels.append(materialize(together(levels[-1]).mapInArrow(combine, m_schema), "products"))
        n = -(-n // fan)
    none = F.lit(None).cast("long")
    states = together(levels[-1].withColumns({"start": none, "goal": none})).mapInArrow(settle, s_schema)
    for level in reversed(levels[:-1]):
        known = states.select(F.col("s_row").alias("g_row"), F.col("s_k").alias("g"), F.col("i").alias("start"), F.col("j").alias("goal"))
        parts_of = level.join(known, (F.col("row") == F.col("g_row")) & ((F.col("k") / fan).cast("long") == F.col("g"))).select("row", "k", "n_in", "m", "start", "goal")
        states = together(parts_of).mapInArrow(settle, s_schema)
    states = materialize(states, "states")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces_of(model)
        for b in batches:
            for r in b.to_pylist():
                packed = Chunk(p, r["piece"], r["start"], r["end"], r["first"], r["last"]).trace(r["i"], r["j"])
                yield pa.RecordBatch.from_pydict({"row": [r["row"]], "k": [r["k"]], "part": _id_lists([packed])})

    joined = chunks.join(states, (F.col("row") == F.col("s_row")) & (F.col("k") == F.col("s_k"))).drop("s_row", "s_k")
    traced = joined.mapInArrow(trace, "row long, k long, part array<int>")
    whole = traced.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("all"))
    whole = whole.select(F.col("row").alias("__of"), F.flatten(F.col("all.part")).alias("ids"), F.size("all").alias("n_chunks"))
    giants = listed.drop("__text").join(whole, F.col("__row") == F.col("__of"))
    return plain.unionByName(giants.select(*[F.col(f"`{c}`") for c in keep], "ids", "n_chunks"))


def decode(rows: DataFrame, ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """rows with the column decoded in the place of the ids: the text the ids stand for (null ids: null).

    The space in front that encoding adds is taken away; control and unknown pieces stand for nothing; bytes that are no
    UTF-8 become U+FFFD.
    """
    names = [c for c in rows.columns if c != ids_col]
    schema = T.StructType([*[rows.schema[c] for c in names], T.StructField("decoded", T.StringType())])
    hand_out(rows.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = pieces_of(model).raw
        for b in batches:
            for i in range(0, b.num_rows, 512):
                some = b.slice(i, 512)
                texts = []
                for ids in some.column(some.num_columns - 1):
                    if not ids.is_valid:
                        texts.append(None)
                        continue
                    t = b"".join([raw[x] for x in ids.values.to_numpy().tolist()]).decode("utf-8", "replace")
                    texts.append(t[1:] if t[:1] == " " else t)
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string())], schema=pa.schema([*list(some.schema)[:-1], pa.field("decoded", pa.string())]))

    return rows.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{ids_col}`").cast("array<int>").alias("__ids")).mapInArrow(run, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and hold both against the text: digests and counts, one row a document."""
    from skein.session import table

    docs = table(spark, sf_dir, "documents")
    seen = F.translate(F.coalesce("text", F.lit("")), SPACE, " ")
    ready = docs.select("doc_id", "text", F.sha2(seen.cast("binary"), 256).alias("text_sha256"))
    coded = encode(ready, keep=["doc_id", "text_sha256"])
    coded = coded.withColumns({"n_tokens": F.size("ids").cast("long"), "ids_xxhash64": F.xxhash64("ids")})
    out = decode(coded)
    decoded = F.sha2(F.col("decoded").cast("binary"), 256)
    return out.select("doc_id", "n_tokens", "n_chunks", "ids_xxhash64", decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("roundtrip"))
