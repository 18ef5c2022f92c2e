"""SentencePiece encoding and decoding with N-best segmentation.

The lattice of a text holds an edge for every vocabulary piece that matches at a position, and for every character that
no piece covers one edge of its UTF-8 bytes (byte fallback). A segmentation's score is the sum of its pieces' scores as
stored in the model. The forward Viterbi pass gives every position the best score of any path to it; the backward A*
search from the end uses these scores as its heuristic, which is exact, so it pops complete segmentations in order.

No piece has the space mark after another character (checked when the vocabulary is read), so no edge crosses the place
before a space mark that follows another character: the lattice falls into independent segments, one a word. The forward
pass runs over all distinct segments of a batch at once in numpy. Of a text's N best segmentations each changes only
segments among the N - 1 with the smallest loss for their second-best path; only for these A* is run, and their
alternatives are combined in order of loss. Ties for the best go to fewer pieces, then to the shorter last piece.

The vocabulary is one of BPE type, so its scores are ranks; the best path under them is the segmentation that is
defined here, and need not be the merge order's.

Decoding joins the pieces, turns byte pieces into bytes and marks into spaces, and drops the space put before the text.
It restores every text exactly: a space mark in the text itself is encoded by bytes.

Defined results: a null text has null ids; the empty text has an empty list. Equal texts get equal ids. An
added column whose name is taken has an underscore put after it.
"""

from __future__ import annotations

import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import added_fields, map_arrow, mix64, slices, text_buffer

MARK = "▁"
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 3
#: Cells (edges times segments) of a batch's matrices; 8 bytes each, in a few copies.
CELLS = 1 << 19
#: Segments longer than this take the plain path; it bounds the batch's matrices.
BATCH_CHARS = 48
#: Stands for a space mark of the text itself. A lone surrogate occurs in no text.
_SENTINEL = "\ud800"


class Vocabulary:
    """Pieces, scores and byte ids of a SentencePiece model file with byte fallback."""

    def __init__(self, path: str = MODEL_PATH):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = np.zeros(256, np.int32)
        self.byte_of: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.score = np.array([sp.get_score(i) for i in range(len(self.pieces))])
        for i, p in enumerate(self.pieces):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.byte_of[i] = int(p[3:5], 16)
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[p] = i
        if len(self.byte_of) != 256:
            raise ValueError("the model has no byte fallback")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has a space mark after another character")
        self.longest = max(map(len, self.ids))
        #: A byte edge costs more than any piece, per byte.
        self.byte_score = float(self.score[list(self.ids.values())].min()) * 2 if min(self.score) > -1e8 else float(self.score[self.score > -1e8].min()) * 2
        #: Added per piece for ties; below half a unit for any path in a batch, and exact in doubles, if scores are whole.
        self.penalty = 1 / 1024 if (self.score == np.round(self.score)).all() else 0.0
        self._table()

    def _table(self) -> None:
        """Open addressing from the hash of a piece's characters to its id."""
        ids = np.array(list(self.ids.values()), np.int32)
        h = np.zeros(len(ids), np.uint64)
        size = np.array([len(p) for p in self.ids])
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            chars = np.frombuffer("".join(p for p in self.ids if len(p) == n).encode("utf-32-le"), np.uint32).reshape(-1, n)
            for k in range(n):
                h[at] = _hash_step(h[at], chars[:, k].astype(np.uint64))
        self.bits = int(4 * len(ids)).bit_length()
        size = 1 << self.bits
        self.keys, self.vals = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        for k, v in zip(h.tolist(), ids.tolist()):
            at = k >> (64 - self.bits)
            while self.vals[at] >= 0:
                if int(self.keys[at]) == k:
                    raise ValueError("two pieces share a hash")
                at = (at + 1) & (size - 1)
            self.keys[at], self.vals[at] = k, v

    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[at] == h, self.vals[at], -1)
        open_ = np.flatnonzero((self.keys[at] != h) & (self.vals[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[at[open_]] == h[open_]
            out[open_[hit]] = self.vals[at[open_[hit]]]
            open_ = open_[~hit & (self.vals[at[open_]] >= 0)]
        return out


_CHAR = np.uint64(0x9DDFEA08EB382D69)


def _hash_step(h: np.ndarray, char: np.ndarray) -> np.ndarray:
    return mix64(h * _CHAR + char + np.uint64(1))


@lru_cache(maxsize=4)
def vocabulary(path: str = MODEL_PATH) -> Vocabulary:
    return Vocabulary(path)


# ------------------------------------------------------------------ one segment: Viterbi, then A*


def edges_of(v: Vocabulary, seg: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
    """Edges that end at each position: (start, score, ids). A mark of the text itself, written _SENTINEL, has bytes only."""
    out: list[list] = [[] for _ in range(len(seg) + 1)]
    for i, c in enumerate(seg):
        covered = False
        for j in range(i + 1, min(len(seg), i + v.longest) + 1):
            k = v.ids.get(seg[i:j]) if _SENTINEL not in seg[i:j] else None
            if k is not None:
                out[j].append((i, float(v.score[k]), (k,)))
                covered |= j == i + 1
        if not covered:
            raw = (MARK if c == _SENTINEL else c).encode()
            out[i + 1].append((i, v.byte_score * len(raw), tuple(v.bytes[list(raw)].tolist())))
    return out


def forward(edges: list) -> tuple[list[float], list]:
    """Viterbi: the best score of any path to each position, and its last edge."""
    best, last = [0.0], [None]
    for into in edges[1:]:
        top = max(into, key=lambda e: (best[e[0]] + e[1], -len(e[2]), -e[0]))
        best.append(best[top[0]] + top[1])
        last.append(top)
    return best, last


def n_best(v: Vocabulary, seg: str, n: int) -> list[tuple[float, list[int]]]:
    """The n best segmentations of a segment, best first: backward A* with the forward scores as exact heuristic."""
    if not seg:
        return [(0.0, [])]
    edges = edges_of(v, seg)
    best, _ = forward(edges)
    out: list[tuple[float, list[int]]] = []
    # (-(score so far + best to the position), position, pieces so far, suffix as a linked list); of equal ones the one
    # nearest to the start first, so that ties cost no more than a path each
    heap: list = [(-best[-1], len(seg), 0, 0, 0.0, None)]
    count = 0
    while heap and len(out) < n:
        _, at, pieces, _, g, tail = heapq.heappop(heap)
        if at == 0:
            ids: list[int] = []
            while tail:
                ids.extend(tail[0])
                tail = tail[1]
            out.append((g, ids))
            continue
        for start, score, ids in edges[at]:
            count += 1
            heapq.heappush(heap, (-(g + score + best[start]), start, pieces + len(ids), count, g + score, (ids, tail)))
    return out


# ------------------------------------------------------------------ all distinct segments of a batch


class Lattices:
    """Best segmentation, its score and the loss of the second-best one, for many segments at once."""

    def __init__(self, v: Vocabulary, segs: list[str]):
        self.v, self.segs = v, segs
        n = len(segs)
        self.best = np.zeros(n)
        self.loss = np.full(n, np.inf)
        self.ids: list[np.ndarray] = [None] * n  # type: ignore[list-item]
        by_len: dict[int, list[int]] = {}
        for i, s in enumerate(segs):
            if len(s) > BATCH_CHARS or _SENTINEL in s:
                self._plain(i)
            else:
                by_len.setdefault(len(s), []).append(i)
        for size, at in by_len.items():
            step = max(1, CELLS // (max(size, 1) * v.longest))
            for k in range(0, len(at), step):
                self._batch(size, np.array(at[k : k + step]))

    def _plain(self, i: int) -> None:
        two = n_best(self.v, self.segs[i], 2)
        self.best[i], self.ids[i] = two[0][0], np.array(two[0][1], np.int32)
        if len(two) > 1:
            self.loss[i] = two[0][0] - two[1][0]

    def _batch(self, size: int, at: np.ndarray) -> None:
        v, m = self.v, len(at)
        if not size:
            for i in at:
                self.ids[i] = np.zeros(0, np.int32)
            return
        chars = np.frombuffer("".join(self.segs[i] for i in at).encode("utf-32-le"), np.uint32).reshape(m, size).T.astype(np.uint64)
        # edge[j, k]: the piece of k + 1 characters that ends at j; its score less a penalty that makes ties go to fewer pieces
        top = min(v.longest, size)
        piece = np.full((size + 1, top, m), -1, np.int32)
        edge = np.full((size + 1, top, m), -np.inf)
        score = np.append(v.score - v.penalty, -np.inf)
        h = np.zeros((size, m), np.uint64)
        for k in range(top):
            h = _hash_step(h[: size - k], chars[k:])
            found = v.find(h.reshape(-1)).reshape(h.shape)
            piece[k + 1 :, k] = found
            edge[k + 1 :, k] = score[found]
        bare = piece[1:, 0] < 0
        if bare.any():
            wide = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
            edge[1:, 0] = np.where(bare, (v.byte_score - v.penalty) * wide, edge[1:, 0])
        alpha = np.full((size + 1, m), -np.inf)
        alpha[0] = 0
        last = np.zeros((size + 1, m), np.int64)
        cols = np.arange(m)
        for j in range(1, size + 1):
            w = min(top, j)
            into = edge[j, :w] + alpha[j - w : j][::-1]
            last[j] = into.argmax(0)
            alpha[j] = into[last[j], cols]
        # the best path's edges, from the end
        steps, pos = [], np.full(m, size)
        on = np.zeros((size + 1, m), bool)
        while (live := pos > 0).any():
            on[pos[live], cols[live]] = True
            k = last[pos, cols]
            steps.append(np.where(live, np.where(piece[pos, k, cols] < 0, -pos - 1, piece[pos, k, cols]), -1))
            pos = np.where(live, pos - k - 1, 0)
        # the second-best path has an edge off the best one: the best of all paths through such an edge
        beta = np.full((size + 1, m), -np.inf)
        beta[size] = 0
        second = np.full(m, -np.inf)
        for j in range(size, 0, -1):
            w = min(top, j)
            out = edge[j, :w] + beta[j]
            through = out + alpha[j - w : j][::-1]
            here = np.flatnonzero(on[j])
            through[last[j, here], here] = -np.inf
            np.maximum(second, through.max(0), out=second)
            back = beta[j - w : j][::-1]
            np.maximum(back, out, out=back)
        loss = alpha[size] - second
        self.loss[at] = np.round(loss) if v.penalty else loss
        path = np.array(steps[::-1]).T
        used = path != -1
        flat, sizes = path[used].astype(np.int32), used.sum(1)
        ends = np.cumsum(sizes)
        for i, b, e in zip(at.tolist(), (ends - sizes).tolist(), ends.tolist()):
            self.ids[i] = flat[b:e]
        total = np.add.reduceat(np.where(flat < 0, 0.0, v.score[flat]), ends - sizes)
        for r in np.flatnonzero((path < -1).any(1)).tolist():
            i, seg = int(at[r]), self.segs[int(at[r])]
            raw = [list(seg[-x - 2].encode()) if x < 0 else None for x in self.ids[i].tolist()]
            total[r] += sum(v.byte_score * len(x) for x in raw if x)
            self.ids[i] = np.array([y for x, c in zip(self.ids[i].tolist(), raw) for y in (v.bytes[c].tolist() if c else [x])], np.int32)
        self.best[at] = total


def segments(text: str) -> list[str]:
    """The text with a space before it, spaces as marks, cut before each mark that follows another character."""
    if MARK in text:
        text = text.replace(MARK, _SENTINEL)
    parts = text.split(" ")
    if "" not in parts:
        return [MARK + p for p in parts]
    out, marks = [], ""
    for p in parts:
        marks += MARK
        if p:
            out.append(marks + p)
            marks = ""
    if marks:
        out.append(marks)
    return out


class Encoder:
    """Encodes batches; segments seen lately are kept."""

    def __init__(self, path: str = MODEL_PATH, keep: int = 500_000):
        self.v, self.keep = vocabulary(path), keep
        self._reset()

    def _learn(self, segs: set[str]) -> None:
        if len(self.index) > self.keep:
            self._reset()
        fresh = [s for s in segs if s not in self.index]
        if not fresh:
            return
        lat = Lattices(self.v, fresh)
        n = len(self.index)
        self.index.update((s, n + i) for i, s in enumerate(fresh))
        size = np.array([len(x) for x in lat.ids], np.int64)
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, *lat.ids])
        self.best = np.concatenate([self.best, lat.best])
        self.loss = np.concatenate([self.loss, lat.loss])

    def _reset(self) -> None:
        self.index: dict[str, int] = {}
        self.others: dict[tuple[str, int], list] = {}
        self.best, self.loss = np.zeros(0), np.zeros(0)
        self.size, self.start, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _alternatives(self, seg: str, at: int, n: int) -> list:
        """The n best of a segment; of equal ones the encoded one comes first."""
        got = self.others.get((seg, n))
        if got is None:
            ids = self.flat[self.start[at] : self.start[at] + self.size[at]].tolist()
            found = n_best(self.v, seg, n)
            got = self.others[seg, n] = [(found[0][0], ids), *[x for x in found if x[1] != ids]][:n]
        return got

    def encode(self, texts: list[str | None], n: int = N_BEST):
        """For each text None, or (ids, best score, losses of the next n - 1 segmentations, their changed segments)."""
        cut = [segments(t) if t else [] for t in texts]
        self._learn({s for c in cut for s in c})
        for t, segs in zip(texts, cut):
            if t is None:
                yield None
                continue
            if not segs:
                yield np.zeros(0, np.int32), 0.0, [], []
                continue
            at = np.fromiter(map(self.index.__getitem__, segs), np.int64, len(segs))
            size = self.size[at]
            total = int(size.sum())
            ids = self.flat[np.arange(total) + np.repeat(self.start[at] - (np.cumsum(size) - size), size)]
            losses, changed = [], []
            if n > 1:
                loss = self.loss[at]
                k = min(n - 1, len(at))
                low = np.argpartition(loss, k - 1)[:k]
                low = low[np.lexsort((low, loss[low]))]
                low = low[np.isfinite(loss[low])]
                options = [(int(p), self._alternatives(segs[p], int(at[p]), n)) for p in low]
                for d, choice in combine([[o[1][0][0] - x[0] for x in o[1]] for o in options], n)[1:]:
                    losses.append(d)
                    changed.append([(options[i][0], options[i][1][c][1]) for i, c in enumerate(choice) if c])
            yield ids, float(self.best[at].sum()), losses, changed


def combine(losses: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n smallest sums of one loss from each list (each sorted, its first 0), with the indexes chosen."""
    first = (0,) * len(losses)
    heap, seen, out = [(0.0, first)], {first}, []
    while heap and len(out) < n:
        d, choice = heapq.heappop(heap)
        out.append((d, choice))
        for i, c in enumerate(choice):
            if c + 1 < len(losses[i]):
                nxt = (*choice[:i], c + 1, *choice[i + 1 :])
                if nxt not in seen:
                    seen.add(nxt)
                    heapq.heappush(heap, (sum(losses[k][x] for k, x in enumerate(nxt)), nxt))
    return out


def decode(ids, v: Vocabulary | None = None) -> str:
    """The text of ids; bytes that are no UTF-8 become the replacement character."""
    v = v or vocabulary()
    raw = b"".join(bytes([v.byte_of[i]]) if i in v.byte_of else v.pieces[i].replace(MARK, " ").encode() for i in ids)
    return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def decode_batch(flat: np.ndarray, offs: np.ndarray, v: Vocabulary) -> list[bytes]:
    """UTF-8 of each row of ids, without the space put first."""
    if not hasattr(v, "raw"):
        raw = [bytes([v.byte_of[i]]) if i in v.byte_of else p.replace(MARK, " ").encode() for i, p in enumerate(v.pieces)]
        v.raw_size = np.array([len(x) for x in raw], np.int64)
        v.raw_start = np.cumsum(v.raw_size) - v.raw_size
        v.raw = np.frombuffer(b"".join(raw), np.uint8)
    size = v.raw_size[flat]
    ends = np.cumsum(size)
    data = v.raw[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(v.raw_start[flat] - (ends - size), size)].tobytes()
    bounds = np.concatenate([[0], ends])[offs]
    return [data[a:b][1:] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


ENCODED = "ids array<int>, n_pieces int, score double, nbest_losses array<double>, nbest_changes array<struct<segment:int,ids:array<int>,rank:int>>, restored boolean"


def encode_documents(docs: DataFrame, keep: list[str], text_col: str = "text", n: int = N_BEST, path: str = MODEL_PATH) -> DataFrame:
    """The columns of `keep` with the best ids, their score, the losses of the next n - 1 segmentations with the segments
    that each changes (rank from 2), and whether decoding gives back the text."""
    held = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("__text"))
    schema = added_fields(ENCODED, held.drop("__text").schema)
    change = pa.list_(pa.struct([("segment", pa.int32()), ("ids", pa.list_(pa.int32())), ("rank", pa.int32())]))

    def run(batches):
        enc = Encoder(path)
        for whole in batches:
            _, offs, _ = text_buffer(whole.column(whole.num_columns - 1))
            for lo, hi in slices(offs, 4 << 20):
                b = whole.slice(lo, hi - lo)
                texts = b.column(b.num_columns - 1)
                null = np.asarray(texts.is_null())
                got = list(enc.encode(texts.to_pylist(), n))
                ids = [g[0] if g else np.zeros(0, np.int32) for g in got]
                size = np.array([len(x) for x in ids], np.int64)
                flat = np.concatenate(ids)
                offsets = np.concatenate([[0], np.cumsum(size)])
                back = decode_batch(flat, offsets, enc.v)
                want = texts.to_pylist()
                same = [None if w is None else w.encode() == x for w, x in zip(want, back)]
                arr = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=pa.array(null))
                cols = [
                    arr,
                    pa.array([len(x) if g else None for g, x in zip(got, ids)], pa.int32()),
                    pa.array([g[1] if g else None for g in got], pa.float64()),
                    pa.array([g[2] if g else None for g in got], pa.list_(pa.float64())),
                    pa.array([[{"segment": p, "ids": x, "rank": r} for r, c in enumerate(g[3], 2) for p, x in c] if g else None for g in got], change),
                    pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return map_arrow(held, run, schema)
