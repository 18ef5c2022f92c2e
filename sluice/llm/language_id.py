"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of orders 0 to ORDER over bytes. A byte's code length in a language is found at the
longest context known there: -log2(count / (total + distinct)) if the byte has followed it, else the escape
-log2(distinct / (total + distinct)) and then the next shorter context's, down to 8 bits for any byte (method C escapes,
no exclusions). The statistics are frozen after training, so the code length of every n-gram seen in training is a
constant: a text's code length is a sum of table look-ups, one row of the table holding all languages.

A text's language is the one with the shortest code; ties go to the first in sorted order. score is the posterior
probability under equal priors, 1 / sum(2 ** (best - length)).

Training reads a bounded sample of labelled rows: of each language the DOCS_PER_LANG texts with the smallest hash of their
text, those of at most MAX_DOC_BYTES first. Where these are too few, longer ones follow, of which the first MAX_DOC_BYTES
are learned; so at most 3.3 MB a language go to the driver. LANGUAGES bounds their number, by all labelled rows. Every text
is scored whole.

Defined results: `und` with score 0 if a text is null or has no letter, or if nothing was learned. Equal texts get equal
results. Rows with a null lang are not learned from. An empty table gives an empty result.
An added column whose name is taken has an underscore put after it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import added_fields, map_arrow, slices, text_buffer

ORDER = 4
DOCS_PER_LANG = 200
MAX_DOC_BYTES = 16_384
#: Languages that are learned at most, those with the most labelled rows.
LANGUAGES = 200
UNKNOWN = "und"

_MUL = np.uint64(0x9E3779B97F4A7C15)


class GramTable:
    """n-gram key -> row number by open addressing in one array of a power-of-two size; at most half full."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(8, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.slot_key = np.full(size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.slot_row = np.full(size, -1, np.int32)
        self.probes = 1
        at, left = self._home(keys), np.arange(len(keys))
        while len(left):
            # the first of those that want a free slot gets it; the rest go to the next slot
            free = self.slot_row[at] < 0
            cand, where = left[free], at[free]
            _, first = np.unique(where, return_index=True)
            self.slot_row[where[first]] = cand[first]
            self.slot_key[where[first]] = keys[cand[first]]
            stay = self.slot_row[at] != left
            left, at = left[stay], (at[stay] + 1) & (size - 1)
            self.probes += bool(len(left))

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MUL) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it has none."""
        at = self._home(keys)
        hit = self.slot_key[at] == keys
        row = np.where(hit, self.slot_row[at], np.int32(-1))
        open_ = np.flatnonzero(~hit & (self.slot_row[at] >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            nxt = (at[open_] + 1) & (len(self.slot_row) - 1)
            at[open_] = nxt
            hit = self.slot_key[nxt] == keys[open_]
            row[open_[hit]] = self.slot_row[nxt[hit]]
            open_ = open_[~hit & (self.slot_row[nxt] >= 0)]
        return row


@dataclass
class PpmModel:
    """langs; per order k: grams[k] with lengths[k] (rows x langs, bits of byte after context), contexts[k] with escapes[k]."""

    langs: list[str]
    order: int
    grams: list[GramTable]
    lengths: list[np.ndarray]
    contexts: list[GramTable]
    escapes: list[np.ndarray]

    def bits(self, buf: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """Code lengths (texts x langs) of the texts buf[cut[i]:cut[i+1]]."""
        n, k = len(cut) - 1, self.order
        size = np.diff(cut)
        if not len(buf):
            return np.zeros((n, len(self.langs)))
        keys = gram_keys(buf, cut, k)
        out = np.zeros((len(buf), len(self.langs)), np.float32)
        rest = np.arange(len(buf))
        cur = keys
        for m in range(k, -1, -1):
            if m < k:
                cur = cur & np.uint64((1 << (8 * (m + 1))) - 1)
            row = self.grams[m].find(cur)
            hit = row >= 0
            out[rest[hit]] += self.lengths[m][row[hit]]
            rest, cur = rest[~hit], cur[~hit]
            if not len(rest):
                break
            ctx = self.contexts[m].find(cur >> np.uint64(8))
            known = ctx >= 0
            out[rest[known]] += self.escapes[m][ctx[known]]
        out[rest] += np.float32(8)
        total = np.zeros((n, len(self.langs)))
        full = np.flatnonzero(size > 0)
        total[full] = np.add.reduceat(out, cut[:-1][full], axis=0, dtype=np.float64)
        return total


def gram_keys(buf: np.ndarray, cut: np.ndarray, order: int) -> np.ndarray:
    """For each byte: the bytes before it (zeros before a text's start) and itself, in the low 8 * (order + 1) bits."""
    key = buf.astype(np.uint64)
    out = key.copy()
    for k in range(1, order + 1):
        out[k:] |= key[:-k] << np.uint64(8 * k)
    starts = cut[:-1][np.diff(cut) > 0]
    for k in range(order):
        at = starts + k
        at = at[at < len(buf)]
        # byte number k of a text has k bytes before it; a shorter text's overrun is set again by its successor's start
        out[at] &= np.uint64((1 << (8 * (k + 1))) - 1)
    for s in starts[np.flatnonzero(np.diff(np.append(starts, len(buf))) < order)].tolist():
        # short texts: mask by the nearest start
        for k in range(order):
            if s + k < len(buf):
                near = int(starts[np.searchsorted(starts, s + k, "right") - 1])
                out[s + k] &= np.uint64((1 << (8 * (s + k - near + 1))) - 1)
    return out


def fit(samples: dict[str, list[bytes]], order: int = ORDER) -> PpmModel:
    langs = sorted(samples)
    keys = []
    for lang in langs:
        texts = [t for t in samples[lang] if t]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        keys.append(gram_keys(buf, np.cumsum([0, *map(len, texts)]), order))
    grams, lengths, contexts, escapes = [], [], [], []
    below = None  # code lengths of the next shorter order: (keys, matrix)
    for m in range(order + 1):
        mask = np.uint64((1 << (8 * (m + 1))) - 1)
        seen = [np.unique(k & mask, return_counts=True) for k in keys]
        rows = np.unique(np.concatenate([s[0] for s in seen])) if seen else np.zeros(0, np.uint64)
        ctx = np.unique(rows >> np.uint64(8))
        esc = np.zeros((len(ctx), len(langs)))
        bits = np.zeros((len(rows), len(langs)))
        back = np.full((len(rows), len(langs)), 8.0) if below is None else below[1][np.searchsorted(below[0], rows & (mask >> np.uint64(8)))]
        of = np.searchsorted(ctx, rows >> np.uint64(8))
        for i, (k, c) in enumerate(seen):
            at = np.searchsorted(ctx, k >> np.uint64(8))
            total = np.bincount(at, c, len(ctx))
            distinct = np.bincount(at, minlength=len(ctx))
            known = total > 0
            esc[known, i] = -np.log2(distinct[known] / (total + distinct)[known])
            bits[:, i] = esc[of, i] + back[:, i]
            bits[np.searchsorted(rows, k), i] = -np.log2(c / (total + distinct)[at])
        grams.append(GramTable(rows))
        contexts.append(GramTable(ctx))
        lengths.append(bits.astype(np.float32))
        escapes.append(esc.astype(np.float32))
        below = (rows, bits)
    return PpmModel(langs, order, grams, lengths, contexts, escapes)


def training_sample(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = DOCS_PER_LANG) -> dict[str, list[bytes]]:
    """The bounded sample of rows with a lang; see the module's head for the bound."""
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    top = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    rows = rows.where(F.col("lang").isin([r.lang for r in top]))
    long = F.octet_length("text") > MAX_DOC_BYTES
    piece = F.substring(F.col("text").cast("binary"), 1, MAX_DOC_BYTES)  # in bytes; the model is over bytes
    rows = rows.select("lang", long.alias("long"), F.xxhash64("text").alias("h"), piece.alias("text"))
    # the limit is pushed below the shuffle, so a task sends at most docs_per_lang rows of a language
    pick = rows.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy("long", "h", "text"))).where(F.col("r") <= docs_per_lang)
    out: dict[str, list[bytes]] = {}
    for r in pick.select("lang", "text").toLocalIterator():
        out.setdefault(r.lang, []).append(bytes(r.text))
    return out


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, docs_per_lang: int = DOCS_PER_LANG) -> PpmModel:
    return fit(training_sample(labelled, text_col, lang_col, docs_per_lang), order)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def score_batch(model: PpmModel, arr: pa.Array) -> tuple[list[str], list[float]]:
    buf, offs, _ = text_buffer(arr)
    langs, scores = [], []
    for lo, hi in slices(offs):
        part = buf[int(offs[lo]) : int(offs[hi])]
        cut = offs[lo : hi + 1] - offs[lo]
        if not model.langs:
            langs += [UNKNOWN] * (hi - lo)
            scores += [0.0] * (hi - lo)
            continue
        bits = model.bits(part, cut)
        best = bits.argmin(1)
        gap = bits - bits[np.arange(len(bits)), best][:, None]
        sure = 1.0 / np.exp2(-np.minimum(gap, 1000.0)).sum(1)
        raw = part.tobytes()
        for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())):
            ok = has_letter(raw[a : min(b, a + 256)].decode("utf-8", "ignore")) or has_letter(raw[a:b].decode("utf-8", "replace"))
            langs.append(model.langs[best[i]] if ok else UNKNOWN)
            scores.append(float(sure[i]) if ok else 0.0)
    return langs, scores


def _shared(df: DataFrame, model: PpmModel):
    return df.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns of `keep` with lang_pred and score, a row per row of docs."""
    held = docs.select(*[F.col(c) for c in keep or []], F.col(text_col).alias("__text"))
    schema = added_fields("lang_pred string, score double", held.drop("__text").schema)
    shared = _shared(docs, model)

    def run(batches):
        for b in batches:
            langs, scores = score_batch(shared.value, b.column(b.num_columns - 1))
            cols = b.columns[:-1]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=schema.names)

    return map_arrow(held, run, schema)


def accept(docs: DataFrame, model: PpmModel, text_col: str = "text", languages: list[str] | None = None) -> DataFrame:
    """The rows of docs whose language is known (one of `languages`, if given), with their own columns."""
    shared, at = _shared(docs, model), docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            langs, _ = score_batch(shared.value, b.column(at))
            yield b.filter(pa.array([x != UNKNOWN and (languages is None or x in languages) for x in langs], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2: rows that training never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
