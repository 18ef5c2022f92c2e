"""N-gram Jaccard join: all links of word shingle sets at or above a Jaccard similarity, as connected components.

1. Every text becomes the sorted array of its shingles' 64-bit hashes. Kept of it: the size n, a 128-bit digest of the
   set, a bitmap signature with about four bits a shingle, and the SPARE smallest hashes. Its keys are the KEYS
   smallest (or the exact prefix n - ceil(t n) + 1, if that is shorter).
2. Documents with equal sets are one class; from here on there is one row a class.
3. Keys of more than HOT classes (lines of licences, say) are hot. A set with hot keys takes as further keys all others
   among its SPARE smallest hashes; if these are at least COLD it gives up its hot ones, else it keeps them too.
4. Classes that share a key meet in a tile. Tiles with equal member lists are worked once, keys of a single class never.
   In a tile only sizes within the factor 1/t meet, and the bit counts of two signatures bound the overlap from above:
   |x & y| <= min(n_x - bits(x not y), n_y - bits(y not x)). Pairs that the bound lets pass are united; the tile emits a
   spanning forest, not its pairs. A tile of more than TILE classes is dealt into chunks; what remains of a chunk are
   its groups as boxes (intersection and union of the signatures, size range), and boxes meet in pairs of chunks by
   the same bound, which for boxes is weaker and so loses nothing.
5. The forest's components (families) hold every pair that may link. In each family the exact sorted arrays are
   intersected, the most typical document first, until all are united or every pair that the bound passes is tested.
   A family of more than FAMILY_SHINGLES is dealt into chunks; the chunks' leaders meet next, and what is then not in
   the family's largest part meets every chunk.

Why the keys lose no link: of the union of two linked sets, each of the KEYS smallest hashes lies in both with
probability t or more, so all of them miss with probability (1 - t) ** KEYS = 6.6e-12 a pair at t = 0.8, for hashes
seeded apart from the data; equal 64-bit hashes of different shingles are of the same order. Cold keys are never given
up, so a pair can lose only shared keys that are hot, and only if one of the two gave them up. That one has COLD cold
hashes or more among its SPARE smallest. Of the union's SPARE smallest hashes, those in both sets are among the stored
of both, and COLD of them less those that are not in both are cold: keys of both. So COLD of these SPARE would have to be
outside one of the sets, each with probability 1 - t or less: 3.3e-11 a pair at t = 0.8, whatever is hot, and never if
the union has fewer than COLD / (1 - t) = 120 shingles. It is no cap: a pair is tested if it shares any key, however many
share it.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component. A
null doc_id has a null component. Rows that repeat a doc_id are one document: their links are joined. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import MULT, map_arrow, materialize, materialize_by, mix64, slices, text_buffer, words_of
from .components import components

WORDS = 5
PERCENT = 80
KEYS = 16
#: Stored hashes of a set, from which a set with hot keys takes others.
SPARE = 32
#: A key of more classes than this is hot.
HOT = 1000
#: A set gives up its hot keys if it has so many others among the stored ones; the others it takes in any case.
COLD = 24
#: Classes in a chunk of a tile.
TILE = 4096
#: Shingles in a chunk of a family (8 bytes each).
FAMILY_SHINGLES = 1 << 21

#: Told apart by their length: sequences shorter than a shingle.
_SHORT = mix64(np.arange(1, 9, dtype=np.uint64) * MULT[7])


# ------------------------------------------------------------------ sets and signatures


def shingle_sets(arr: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; texts with fewer words have the whole sequence as one."""
    buf, offs, _ = text_buffer(arr)
    for lo, hi in slices(offs):
        h, first = words_of(buf, offs, lo, hi)
        n = len(h)
        if n >= words:
            s = np.zeros(n - words + 1, np.uint64)
            for k in range(words):
                s += h[k : n - words + 1 + k] * MULT[k]
            s = mix64(s)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(s[a : b - words + 1])
            elif b > a:
                yield mix64((h[a:b] * MULT[: b - a]).sum(keepdims=True) ^ _SHORT[b - a])
            else:
                yield np.zeros(0, np.uint64)


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """The signature of width bits (a power of two, 64 or more) as 64-bit words. Its halves' OR is that of width / 2."""
    at = s & np.uint64(width - 1)
    bits = np.zeros(width, np.uint8)
    bits[at.astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def bitmap_width(n: int) -> int:
    return 1 << max(6, int(4 * n - 1).bit_length())


def fold(b: np.ndarray, words: int) -> np.ndarray:
    """To fewer words by OR. A set bit still says that a member (each member, in an intersection) has a shingle there."""
    while len(b) > words:
        half = len(b) // 2
        b = b[:half] | b[half:]
    return b


SIGNATURE = "doc_id long, n long, d1 long, d2 long, keys array<long>, bits binary"


def _signatures(words: int, percent: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())])

    def run(batches):
        for batch in batches:
            n, d1, d2, keys, bits = [], [], [], [], []
            for s in shingle_sets(batch.column(1), words):
                k = len(s)
                n.append(k)
                d1.append(int(mix64(s ^ MULT[5]).sum().astype(np.int64)) if k else 0)
                d2.append(int(mix64(s * MULT[6]).sum().astype(np.int64)) if k else 0)
                keys.append(s[:SPARE].view(np.int64))
                bits.append(bitmap(s, bitmap_width(k)).tobytes() if k else b"")
            lens = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.ListArray.from_arrays(pa.array(lens), pa.array(flat)), pa.array(bits, pa.binary())], schema=schema)

    return run


# ------------------------------------------------------------------ groups of a sorted partition


def groups_of(batches, n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal values of the first n_keys columns, over batches sorted by them."""
    held: list = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(new).tolist()
        for a, b in zip(at, [*at[1:], batch.num_rows]):
            k = tuple(int(c[a]) for c in cols)
            if k != key and held:
                yield key, pa.Table.from_batches(held)
                held = []
            key = k
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held)


class Union:
    """Labels of items: uniting relabels the whole of the other part."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def unite(self, i: int, others: np.ndarray) -> None:
        if len(others):
            old = np.unique(self.label[others])
            old = old[old != self.label[i]]
            if len(old):
                self.label[np.isin(self.label, old)] = self.label[i]


def _percent_ok(inter, a, b, percent):
    return 100 * inter >= percent * (a + b - inter)


def box_components(low: np.ndarray, high: np.ndarray, every: np.ndarray, some: np.ndarray, percent: int) -> np.ndarray:
    """Labels of boxes that may hold a linked pair. every/some: intersection and union of the members' signatures.

    For members x of i and y of j: |x & y| <= n_x - bits(every_i not some_j), and the like; with the size ranges this
    bounds the similarity of any such pair from above.
    """
    g = len(low)
    u = Union(g)
    order = np.argsort(low, kind="stable")
    low, high, every, some = low[order], high[order], every[order], some[order]
    for i in range(g - 1):
        # later boxes start at a size of low[i] or more
        end = int(np.searchsorted(low, high[i] * 100 // percent, "right"))
        j = np.arange(i + 1, end)
        j = j[u.label[j] != u.label[i]]
        if not len(j):
            continue
        lost_i = np.bitwise_count(every[i] & ~some[j]).sum(1, dtype=np.int64)
        lost_j = np.bitwise_count(every[j] & ~some[i]).sum(1, dtype=np.int64)
        a = high[i] - lost_i
        b = high[j] - lost_j
        top = np.minimum(a, b)
        # |x | y| = |x| + |y| - |x & y|, and also |x & y| + |x - y| + |y - x|
        least = np.maximum(low[i] + low[j] - top, top + lost_i + lost_j)
        u.unite(i, j[(top > 0) & (100 * top >= percent * least)])
    out = np.empty(g, np.int64)
    out[order] = u.label
    return out


BOX = "a long, b long, low long, high long, every binary, some binary"


def _tiles(percent: int):
    """Over (key, sub, hot, node, low, high, every, some) sorted by key and sub: forest edges (a, b); for hot tiles also boxes."""
    schema = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("every", pa.binary()), ("some", pa.binary())])

    def run(batches):
        out = []
        for (key, _), t in groups_of(batches, 2):
            node = t["node"].to_numpy()
            hot = t["hot"][0].as_py()
            if len(node) < 2 and not hot:
                continue
            low, high = t["low"].to_numpy(), t["high"].to_numpy()
            ev = [np.frombuffer(x, np.uint64) for x in t["every"].to_pylist()]
            so = [np.frombuffer(x, np.uint64) for x in t["some"].to_pylist()]
            # sizes that may meet differ by the factor 1/t at most, so their widths are equal or adjacent; boxes hold
            # several sizes and are all folded to the least width
            width = np.array([len(x) for x in so])
            if (low != high).any():
                width[:] = width.min()
            label = np.arange(len(node))
            for words in np.unique(width).tolist():
                at = np.flatnonzero((width == words) | (width == 2 * words))
                e, s = np.stack([fold(ev[k], words) for k in at]), np.stack([fold(so[k], words) for k in at])
                part = box_components(low[at], high[at], e, s, percent)
                for p in np.unique(part):
                    m = at[part == p]
                    if len(m) > 1:
                        old = np.unique(label[m])
                        label[np.isin(label, old)] = old[0]
            for p in np.unique(label):
                m = np.flatnonzero(label == p)
                root = int(node[m].min())
                out += [(key, root, int(x), None, None, None, None) for x in node[m] if x != root]
                if hot:
                    words = min(len(so[k]) for k in m)
                    e = np.bitwise_and.reduce([fold(ev[k], words) for k in m])
                    s = np.bitwise_or.reduce([fold(so[k], words) for k in m])
                    out.append((key, root, None, int(low[m].min()), int(high[m].max()), e.tobytes(), s.tobytes()))
            if len(out) > 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema=schema)

    return run


# ------------------------------------------------------------------ exact families


def exact_components(sets: list[np.ndarray], percent: int, against: np.ndarray | None = None) -> np.ndarray:
    """Labels of the sets' components by exact intersection. against: initial labels (equal labels are known as linked)."""
    g = len(sets)
    size = np.array([len(s) for s in sets])
    u = Union(g)
    if against is not None:
        u.label = np.unique(against, return_inverse=True)[1].astype(np.int64)
    if g == 2:
        order = np.arange(2)
    else:
        # typical documents first: those whose shingles many of the family have
        flat = np.concatenate(sets)
        _, inv, count = np.unique(flat, return_inverse=True, return_counts=True)
        start = np.cumsum(size) - size
        order = np.argsort(-np.add.reduceat(count[inv], start) / size, kind="stable")
    flat = np.concatenate([sets[k] for k in order])
    sz = size[order]
    start = np.concatenate([[0], np.cumsum(sz)])
    lab = Union(g)
    lab.label = u.label[order]
    bits = None
    if g > 32:
        words = bitmap_width(int(np.median(sz))) // 64
        bits = np.stack([fold(bitmap(sets[k], max(64 * words, bitmap_width(len(sets[k])))), words) for k in order])
    for i in range(g - 1):
        j = np.arange(i + 1, g)
        j = j[(lab.label[i + 1 :] != lab.label[i]) & (100 * np.minimum(sz[i], sz[i + 1 :]) >= percent * np.maximum(sz[i], sz[i + 1 :]))]
        if bits is not None and len(j):
            lost_i = np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64)
            lost_j = np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64)
            j = j[_percent_ok(np.minimum(sz[i] - lost_i, sz[j] - lost_j), sz[i], sz[j], percent)]
        mine = flat[start[i] : start[i + 1]]
        # blocks: members linked by an earlier block's hit need no test
        for at in range(0, len(j), 1024):
            k = j[at : at + 1024]
            k = k[lab.label[k] != lab.label[i]]
            if not len(k):
                continue
            rows = np.concatenate([flat[start[x] : start[x + 1]] for x in k])
            pos = np.minimum(np.searchsorted(mine, rows), len(mine) - 1)
            inter = np.add.reduceat((mine[pos] == rows).astype(np.int64), np.cumsum(sz[k]) - sz[k])
            lab.unite(i, k[_percent_ok(inter, sz[i], sz[k], percent)])
    out = np.empty(g, np.int64)
    out[order] = lab.label
    return out


def _families(words: int, percent: int):
    """Over (fam, sub, node, known, text) sorted by fam and sub: (fam, node, label), label the least node linked so far."""
    schema = pa.schema([("fam", pa.int64()), ("node", pa.int64()), ("label", pa.int64())])

    def run(batches):
        for (fam, _), t in groups_of(batches, 2):
            node, known = t["node"].to_numpy(), t["known"].to_numpy()
            if len(node) > 1:
                label = exact_components([s for c in t["text"].chunks for s in shingle_sets(c, words)], percent, known)
            else:
                label = np.zeros(1, np.int64)
            least = np.full(len(node), np.iinfo(np.int64).max)
            np.minimum.at(least, label, np.minimum(node, known))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), fam)), pa.array(node), pa.array(least[label])], schema=schema)

    return run


def _in_groups(df: DataFrame, keys: list[str], fn, schema: str) -> DataFrame:
    return map_arrow(df.repartition(*keys).sortWithinPartitions(*keys), fn, schema)


# ------------------------------------------------------------------ the join


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, tile: int = TILE, family_shingles: int = FAMILY_SHINGLES) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id that links reach)."""
    whole = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # by row, so that what follows reads keys and signatures of chosen rows without a shuffle of them
    sig = materialize_by(map_arrow(whole, _signatures(words, percent), SIGNATURE).withColumn("row", F.monotonically_increasing_id()), "signatures", "row")
    full = sig.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = F.min(F.struct("doc_id", "row"))  # one row of the class, and its doc_id
    classes = materialize(full.groupBy("n", "d1", "d2").agg(first.alias("r")).select("n", "d1", "d2", F.col("r.doc_id").alias("node"), F.col("r.row").alias("row")), "classes")
    of_class = full.select("doc_id", "n", "d1", "d2").join(classes.drop("row"), ["n", "d1", "d2"])
    same = of_class.where("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))

    # tiles: keys of two or more classes, one for each list of members
    nodes = full.select("row", F.col("doc_id").alias("node"), "n", "keys", "bits").join(classes.select("row"), "row", "left_semi")
    prefix = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1
    keyed = nodes.select("row", "node", "n", F.explode(F.slice("keys", F.lit(1), F.least(F.lit(KEYS), prefix).cast("int"))).alias("key"))
    heat = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hot).select("key", F.lit(True).alias("is_hot")), "hot-keys")
    if not heat.isEmpty():
        # a set's row, as a doc_id that is repeated has several sets
        hot_keyed = materialize(keyed.join(heat, "key", "left_semi"), "hot-keyed")
        touched = hot_keyed.select("row").distinct()
        spare = nodes.join(touched, "row", "left_semi").select("row", "node", "n", F.explode("keys").alias("key"))
        spare = materialize(spare.join(heat, "key", "left").where("is_hot is null").select("row", "node", "n", "key"), "cold-keys")
        moved = spare.groupBy("row").agg(F.count(F.lit(1)).alias("cold")).where(F.col("cold") >= COLD).select("row")
        # every touched set has its cold keys, so that those that gave up hot ones meet those that did not
        keyed = keyed.join(touched, "row", "left_anti").unionByName(spare).unionByName(hot_keyed.join(moved, "row", "left_anti"))
    # lists of members are told apart by their number and two hashes; no size decides how the lists come back to the members
    same_list = [F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("row")).alias("x"), F.sum(F.xxhash64("node", "row").bitwiseAND(0xFFFFFFFF)).alias("s")]
    lists = keyed.groupBy("key").agg(*same_list).where("members > 1")
    lists = materialize(lists.groupBy("members", "x", "s").agg(F.min("key").alias("key")).select("key", "members"), "tiles")
    chunks = F.ceil(F.col("members") / F.lit(float(tile))).cast("int")
    member = keyed.join(lists.hint("merge"), "key").select("row", "key", F.pmod(F.xxhash64("node"), chunks).cast("long").alias("sub"), (chunks > 1).alias("hot"), "node", "n")
    member = member.join(sig.select("row", "bits"), "row").select("key", "sub", "hot", "node", F.col("n").alias("low"), F.col("n").alias("high"), F.col("bits").alias("every"), F.col("bits").alias("some"))
    first = materialize(_in_groups(member, ["key", "sub"], _tiles(percent), f"key long, {BOX}"), "tile-forest")
    forest = first.where("b is not null").select("a", "b")
    boxes = first.where("b is null")
    if not boxes.isEmpty():
        many = boxes.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).cast("int").alias("c"))
        mine = boxes.join(many, "key").withColumn("i", F.pmod(F.xxhash64("a", "low", "every"), F.col("c")))
        pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: (F.least(F.col("i"), j.cast("long")) * F.col("c") + F.greatest(F.col("i"), j.cast("long"))).cast("long")))
        mine = mine.select("key", pair.alias("sub"), F.lit(False).alias("hot"), F.col("a").alias("node"), "low", "high", "every", "some")
        again = _in_groups(mine, ["key", "sub"], _tiles(percent), f"key long, {BOX}")
        forest = forest.union(materialize(again.select("a", "b"), "box-forest"))

    family = components(forest.distinct())  # node, component
    weighed = nodes.select("node", "n").join(family, "node").select(F.col("component").alias("fam"), "node", "n")
    family = materialize(weighed.join(weighed.groupBy("fam").agg(F.ceil(F.sum("n") / F.lit(float(family_shingles))).cast("int").alias("c")), "fam"), "families")
    sub = F.pmod(F.xxhash64("node"), F.col("c")).cast("long")

    def with_text(rows: DataFrame) -> DataFrame:
        """Each class's text, once: rows by node; a doc_id that is repeated with other texts counts with all of them."""
        ids = rows.select(F.col("node").alias("doc_id")).distinct()
        texts = bloom.prefilter(whole, "doc_id", bloom.build(ids))
        return rows.join(texts.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumnRenamed("doc_id", "node"), "node")

    fam_schema = "fam long, node long, label long"
    dealt = with_text(family.select("fam", sub.alias("sub"), "node", "c").distinct())
    one = materialize(_in_groups(dealt.select("fam", "sub", "node", F.col("node").alias("known"), "text"), ["fam", "sub"], _families(words, percent), fam_schema), "family-links")
    links = one.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    big = family.where("c > 1").select("fam", "node", "c").distinct()
    if not big.isEmpty():
        big = materialize(big.join(one.select("node", "label").groupBy("node").agg(F.min("label").alias("label")), "node"), "big")
        # the chunks' leaders
        lead = big.where("node = label")
        c2 = lead.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(tile))).cast("int").alias("c2"))
        lead = lead.join(c2, "fam").select("fam", F.pmod(F.xxhash64("node"), F.col("c2")).cast("long").alias("sub"), "node", F.col("node").alias("known"))
        two = materialize(_in_groups(with_text(lead), ["fam", "sub"], _families(words, percent), fam_schema), "leader-links").where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        now = big.join(components(two.union(big.select(F.col("node").alias("a"), F.col("label").alias("b")))).withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
        now = materialize(now, "parts")
        # outside the largest part: these meet every chunk of their family
        parts = now.groupBy("fam", "part").agg(F.count(F.lit(1)).alias("m"))
        top = parts.groupBy("fam").agg(F.max_by("part", F.struct("m", "part")).alias("top"), F.count(F.lit(1)).alias("k"), (F.sum("m") - F.max("m")).alias("out")).where("k > 1")
        left = now.join(top, "fam").withColumn("s", F.ceil(F.col("out") / F.lit(float(tile))).cast("int"))
        if not left.isEmpty():
            inside = F.pmod(F.xxhash64("node"), F.col("c")).cast("long")
            outer = left.where("part != top").select("fam", "node", "part", F.explode(F.sequence(F.lit(0), F.col("c") - 1)).alias("i"), F.pmod(F.xxhash64("node", "fam"), F.col("s")).alias("j"), "s")
            inner = left.select("fam", "node", "part", inside.alias("i"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("j"), "s")
            met = outer.union(inner).select("fam", (F.col("i") * F.col("s") + F.col("j")).cast("long").alias("sub"), "node", F.col("part").alias("known")).distinct()
            three = _in_groups(with_text(met).select("fam", "sub", "node", "known", "text"), ["fam", "sub"], _families(words, percent), fam_schema)
            three = materialize(three.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct(), "residual-links")
            links = links.union(three)
        links = links.union(two)
    linked = components(links.union(same).distinct()).select(F.col("node").alias("doc_id"), "component")
    return sig.select("doc_id", F.col("n").alias("n_shingles")).join(linked, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def dedup_near(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose doc_id is the smallest of its component; rows without a doc_id stay."""
    groups = jaccard_components(docs, words, percent, id_col, text_col)
    gone = groups.where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(id_col) == F.col("__gone"), "left_anti")
