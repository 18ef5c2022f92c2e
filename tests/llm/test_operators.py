"""Small fixtures against brute force: nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import components as cc
from sluice.llm import exact_dedup, language_id, lm_scoring, media, mixing, ngram_jaccard, piece_lattice, token_counts, token_output, tokens, url_filters

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
BASE = "one two three four five six seven eight nine ten " * 3 + " ".join(f"tail{i}" for i in range(60))
ROWS = [
    (1, "Hello  world\tagain and again", "en", "a"),
    (2, "hello world again and again", "en", "a"),
    (3, "Hello world again and again", "en", None),
    (4, None, None, "b"),
    (5, "", "en", "b"),
    (6, "  \n", "fr", "b"),
    (7, BASE, "en", "a"),
    (8, BASE + " extra", "en", "a"),
    (9, BASE.replace("tail59", "other"), None, "a"),
    (9, BASE.replace("tail59", "other"), None, "a"),
    (10, LONG, "en", "a"),
    (11, LONG + " end", "de", "c"),
    (None, "no id here at all, none", "en", "a"),
    (12, "é ▁ 日本 😀", "fr", "a"),
    (13, "12345 --- 678", "en", "a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "clash", 7) for r in ROWS], SCHEMA + ", digest string, n long").repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


# ------------------------------------------------------------------ 9


def test_exact_dedup(spark, docs):
    groups = defaultdict(list)
    for i, t, *_ in ROWS:
        groups[norm(t)].append(i)
    rows = exact_dedup.decide(docs).collect()
    assert len(rows) == len(ROWS)
    by_id = {r[0]: r[1] for r in ROWS}
    for r in rows:
        same = groups[norm(by_id[r.doc_id])]
        least = min((i for i in same if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (least, len(same), r.doc_id == least)
        assert r.text_sha256 == hashlib.sha256(norm(by_id[r.doc_id]).encode()).hexdigest()
    kept = exact_dedup.dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == sorted(min((i or 0) for i in g) for g in groups.values())
    assert exact_dedup.decide(docs.limit(0)).count() == 0
    hot = exact_dedup.decide(docs, hot_rows=1)
    assert sorted(map(repr, hot.collect())) == sorted(map(repr, rows))
    plan = hot._jdf.queryExecution().executedPlan().toString()
    assert "Union" in plan and "BroadcastHashJoin" in plan


def test_digest_index_takes_in_batches(spark, docs):
    index = exact_dedup.DigestIndex(spark, buckets=3)
    first = exact_dedup.decide(docs.where("doc_id <= 3"), index, batches=1)
    assert first.where("kept").count() == 2
    n = index.table().count()
    again = exact_dedup.decide(docs.where("doc_id <= 3"), index, batches=1)
    assert index.table().count() == n and again.where("kept").count() == 2
    late = spark.createDataFrame([(90, "hello world again and again"), (91, "new")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.decide(late, index, batches=1).collect()} == {(90, 2), (91, 91)}


APPLICATION = """
import sys
from pyspark.sql import SparkSession
from sluice.llm import exact_dedup
path, shared, rows = sys.argv[1], sys.argv[2], eval(sys.argv[3])
spark = (
    SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "3").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", shared).config("spark.sql.warehouse.dir", shared + "/warehouse").getOrCreate()
)
index = exact_dedup.DigestIndex(spark, path=path)
out = exact_dedup.decide(spark.createDataFrame(rows, "doc_id long, text string"), index)
print("ROWS", sorted((r.doc_id, r.keep_id, r.kept) for r in out.collect()), index.table().count(), index.buckets)
"""


def application(tmp_path, rows):
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    done = subprocess.run([sys.executable, "-c", APPLICATION, f"{tmp_path}/index", str(tmp_path), repr(rows)], env=env, capture_output=True, text=True, timeout=300)
    found = [line for line in done.stdout.splitlines() if line.startswith("ROWS")]
    assert found, done.stderr[-2000:]
    return found[0]


def test_digest_index_outlives_its_application(tmp_path):
    assert application(tmp_path, [(1, "a"), (2, "b"), (3, "a")]) == "ROWS [(1, 1, True), (2, 2, True), (3, 1, False)] 2 3"
    assert application(tmp_path, [(7, "a"), (8, "c")]) == "ROWS [(7, 1, False), (8, 8, True)] 3 3"
    assert application(tmp_path, [(7, "a"), (8, "c")]) == "ROWS [(7, 1, False), (8, 8, True)] 3 3"


def test_digest_index_keeps_to_its_folder(spark, tmp_path):
    rows = exact_dedup._digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"), "doc_id", "text")
    index = exact_dedup.DigestIndex(spark, path=f"{tmp_path}/i", buckets=2)
    index.ingest(rows)

    def broken(batches):
        raise ValueError("lost")
        yield

    with pytest.raises(Exception, match="lost"):
        index.ingest(rows.limit(0).unionByName(rows.mapInArrow(broken, rows.schema)))
    again = exact_dedup.DigestIndex(spark, path=f"{tmp_path}/i", buckets=9)
    assert again.buckets == 2 and again.table().count() == 2
    again.ingest(rows.limit(0))
    assert again.table().count() == 2
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, name=index.name, path=f"{tmp_path}/j").ingest(rows)
    os.makedirs(f"{tmp_path}/k")
    open(f"{tmp_path}/k/other.txt", "w").close()
    with pytest.raises(ValueError):
        exact_dedup.DigestIndex(spark, path=f"{tmp_path}/k").ingest(rows)
    assert os.listdir(f"{tmp_path}/k") == ["other.txt"]


# ------------------------------------------------------------------ 1


def test_poisson_replication(spark, docs):
    rates = {r.source: r for r in mixing.source_rates(docs).collect()}
    total = sum(math.sqrt(n) for n in Counter(r[3] for r in ROWS).values())
    rows = mixing.mix(docs).collect()
    got = Counter(r.doc_id for r in rows)
    for i, _, _, s in ROWS:
        n = sum(x[3] == s for x in ROWS)
        rate = len(ROWS) * math.sqrt(n) / total / n
        assert rates[s].rate == pytest.approx(rate)
        u = int(hashlib.md5(f"17:{'' if i is None else i}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        assert got[i] == k * sum(x[0] == i for x in ROWS)
    keys = [r.shuffle_key for r in mixing.mix(docs).collect()]
    assert keys == sorted(keys)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs, weights={"c": 1.0}, target_rows=1400.0).count() == pytest.approx(1400, abs=200)


def test_mixture_follows_the_weights(spark):
    many = spark.range(20_000).selectExpr("id doc_id", "if(id < 15000, 'big', 'small') source", "'t' text")
    got = {r.source: r["count"] for r in mixing.mix(many, weights={"big": 1.0, "small": 3.0}).groupBy("source").count().collect()}
    assert got["big"] == pytest.approx(5_000, rel=0.06) and got["small"] == pytest.approx(15_000, rel=0.06)


# ------------------------------------------------------------------ 7


def shingles(t, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower() if (t or "").isascii() else re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows):
    ids = [(i, shingles(t)) for i, t in rows]
    comp = {i: i for i, _ in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a, (i, x) in enumerate(ids):
        for j, y in ids[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y) and None not in (i, j):
                p, q = find(i), find(j)
                if p != q:
                    comp[max(p, q)] = min(p, q)
    return {i: (len(s), None if i is None else find(i)) for i, s in ids}


def test_ngram_jaccard(spark, docs):
    want = brute_components([r[:2] for r in ROWS])
    got = ngram_jaccard.jaccard_components(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got)
    left = ngram_jaccard.dedup_near(docs)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, (_, c) in want.items() if i == c}
    assert ngram_jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_ngram_jaccard_in_chunks(spark):
    """A large family, a chain and passages that many share, with chunk sizes that force every step."""
    rng = np.random.default_rng(4)
    words = [f"v{i}" for i in range(400)]
    base, passage = list(rng.choice(words, 120)), list(rng.choice(words, 40))
    rows = []
    for i in range(150):
        t = list(base)
        for _ in range(int(rng.integers(0, 5))):
            t[int(rng.integers(0, 120))] = "e" + str(rng.integers(0, 10**6))
        rows.append((i, " ".join(t)))
    for i in range(150, 210):
        rows.append((i, " ".join([*passage, *rng.choice(words, 30)])))
    chain = list(rng.choice(words, 100))
    for i in range(210, 230):
        chain[(i * 5) % 100] = f"c{i}"
        rows.append((i, " ".join(chain)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows)
    for hot in (10, 1000):
        for r in ngram_jaccard.jaccard_components(frame, hot=hot, tile=16, family_shingles=2_000).collect():
            assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_ngram_jaccard_hot_groups_of_short_texts(spark):
    """Near copies with only hot keys, of two sizes: the shorter have more than COLD other hashes, the longer often fewer."""
    rows = [(120 * g + i, " ".join([*(f"b{g}x{k}" for k in range(43 if i < 60 else 37)), f"u{i}"])) for g in range(8) for i in range(120)]
    want = brute_components(rows)
    assert len({c for _, c in want.values()}) == 8
    for r in ngram_jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), hot=40).collect():
        assert (r.n_shingles, r.component_id) == want[r.doc_id]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    got = dict(map(tuple, cc.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 150: 100, 200: 100}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------------ 6


def code_length(samples, text, order=4):
    stats = defaultdict(Counter)
    for s in samples:
        y = bytes(order) + s
        for i in range(order, len(y)):
            for k in range(order + 1):
                stats[y[i - k : i]][y[i]] += 1
    total, y = 0.0, bytes(order) + text
    for i in range(order, len(y)):
        for k in range(order, -1, -1):
            if c := stats.get(y[i - k : i]):
                n = sum(c.values()) + len(c)
                if y[i] in c:
                    total -= math.log2(c[y[i]] / n)
                    break
                total -= math.log2(len(c) / n)
        else:
            total += 8
    return total


def test_ppm_code_lengths():
    rng = np.random.default_rng(1)
    samples = {"a": [bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in (1, 2, 3, 50, 200)], "b": [bytes(rng.integers(98, 104, n).astype(np.uint8)) for n in (4, 7, 300)] + [b""]}
    model = language_id.fit(samples)
    texts = [b"abcd", b"", b"a", b"ab", b"bcdefgzz", b"c", bytes(rng.integers(97, 106, 100).astype(np.uint8))]
    bits = model.bits(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    for i, t in enumerate(texts):
        assert bits[i] == pytest.approx([code_length(samples[x], t) for x in model.langs], abs=1e-3)


def test_language_id(spark, docs):
    model = language_id.train(docs)
    rows = language_id.identify(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == len(ROWS)
    text = {r[0]: r[1] for r in ROWS}
    for r in rows:
        letter = any(map(str.isalpha, text[r.doc_id] or ""))
        assert (r.lang_pred in model.langs) == letter and (r.lang_pred == "und") == (not letter) and 0 <= r.score <= 1
    left = language_id.accept(docs, model)
    assert left.schema == docs.schema and {r.doc_id for r in left.collect()} == {r[0] for r in ROWS} - {4, 5, 6, 13}
    assert language_id.identify(docs, language_id.train(docs.limit(0)), keep=[]).where("lang_pred != 'und'").count() == 0


def test_language_of_long_texts_only_is_learned(spark):
    long = ["é" + "żółć gęślą jaźń " * 1500 + str(i) for i in range(3)]
    rows = [("en", f"the quick brown fox {i}") for i in range(5)] + [("pl", t) for t in long] + [("xx", None), (None, "none")]
    frame = spark.createDataFrame(rows, "lang string, text string")
    sample = language_id.training_sample(frame)
    assert sorted(sample["en"]) == sorted(t.encode() for x, t in rows if x == "en") and set(sample) == {"en", "pl"}
    assert Counter(sample["pl"]) == Counter(t.encode()[: language_id.MAX_DOC_BYTES] for t in long)
    got = language_id.identify(frame.where("lang = 'pl'"), language_id.train(frame), keep=[]).collect()
    assert [r.lang_pred for r in got] == ["pl"] * 3


def test_language_id_held_out_accuracy(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("out", language_id.held_out())
    model = language_id.train(frame.where("not out"))
    got = language_id.identify(frame.where("out"), model, keep=["lang"]).selectExpr("avg(cast(lang = lang_pred as double))").first()[0]
    assert got > 0.97


# ------------------------------------------------------------------ 3 and 4


def test_bpe_ids():
    enc = tokens.BpeEncoder(tokens.TOKENIZERS["byte_bpe_50k"])
    texts = [r[1] for r in ROWS] + [" lead", "trail ", "a  b", "x \n y", "it's we'll 's", "<|endoftext|>"]
    want = [enc.bpe.encode_ordinary(t) if t else [] for t in texts]
    assert [x.tolist() for x in enc.encode(texts)] == want and enc.counts(texts).tolist() == [len(x) for x in want]


def test_token_rollup(spark, docs):
    counted = token_counts.count_tokens(docs, ["doc_id", "source", "lang"]).cache()
    bpe = {k: tokens.BpeEncoder(p).bpe for k, p in tokens.TOKENIZERS.items()}

    def brute(rows):
        out = defaultdict(lambda: [0, 0, 0])
        for _, t, lang, source in rows:
            for k, e in bpe.items():
                for i, x in enumerate((1, len(e.encode_ordinary(t or "")), len((t or "").encode()))):
                    out[source, lang, k][i] += x
        return {k: tuple(v) for k, v in out.items()}

    def totals():
        return {(r.source, r.lang, r.tokenizer): (r.docs, r.tokens, r.bytes) for r in rollup.totals().collect()}

    rollup = token_counts.TokenRollup(spark)
    assert rollup.commit("one", token_counts.changes(counted.where("doc_id <= 6")))
    assert rollup.commit("two", token_counts.changes(counted.where("doc_id > 6 or doc_id is null")))
    assert not rollup.commit("two", token_counts.changes(counted))
    assert totals() == brute(ROWS)
    assert rollup.commit("gone", token_counts.changes(counted.where("doc_id = 10"), -1))
    new = counted.where("doc_id = 1").withColumn("source", counted.lang)
    assert rollup.commit("moved", token_counts.revisions(counted.where("doc_id = 1"), new))
    assert rollup.commit("empty", token_counts.changes(counted.limit(0)))
    assert totals() == brute([(i, t, lang, "en" if i == 1 else s) for i, t, lang, s in ROWS if i != 10])


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = token_output.Feistel(n)
    slots = f.forward(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n)) and f.inverse(slots).tolist() == list(range(n))


def test_training_order(spark, docs):
    rows, path, sizes = token_output.write_training_order(docs, length=64, shards=3)
    got, n = rows.orderBy("slot").collect(), sum(sizes)
    assert [r.slot for r in got] == list(range(n)) and [r.place for r in got] == sorted({r.place for r in got})
    reader = token_output.ShardReader(path, sizes, 64)
    stored = list(reader.read(0, n))
    assert [zlib.crc32(x.astype("<u2").tobytes()) for x in stored] == [r.crc32 for r in got]
    assert [x.tolist() for x in reader.read(n // 2, 5)] == [x.tolist() for x in stored[n // 2 : n // 2 + 5]]
    # in the order of their numbers the sequences are the documents' streams, whole
    bound = sum(-(-sum(len((t or "").encode()) + 1 for t in part) // 64) for part in docs.rdd.map(lambda r: r.text).glom().collect())
    order = token_output.Feistel(bound).inverse(np.array([r.place for r in got]))
    stream = np.concatenate([stored[k][: got[k].n_ids] for k in np.argsort(order)]).tolist()
    enc = tokens.BpeEncoder(tokens.TOKENIZERS["byte_bpe_50k"])
    parts, cur = [], []
    for x in stream:
        cur.append(x)
        if x == token_output.END_OF_TEXT:
            parts.append(tuple(cur))
            cur = []
    want = Counter((*enc.bpe.encode_ordinary(t or ""), token_output.END_OF_TEXT) for _, t, *_ in ROWS)
    assert Counter(parts) == want and not cur
    empty = token_output.write_training_order(docs.limit(0))
    assert empty[0].count() == 0 and sum(empty[2]) == 0


def test_training_order_fails_if_a_row_is_lost_between_the_passes(spark, docs, tmp_path, monkeypatch):
    mark = str(tmp_path / "seen")

    def once(batches):
        for b in batches:
            yield b.slice(1) if os.path.exists(mark) else b
        open(mark, "w").close()

    monkeypatch.setattr(token_output, "_stable", lambda rows: True)
    short = docs.select("doc_id", "text").where("doc_id <= 5").coalesce(1).mapInArrow(once, "doc_id long, text string")
    with pytest.raises(Exception, match="partitions changed"):
        token_output.write_training_order(short, length=64)


# ------------------------------------------------------------------ 5


def test_lm_classes_by_use(spark, docs):
    counts, near = lm_scoring.count_buckets(docs)
    signs, want, n = lm_scoring.signs_of(), defaultdict(lambda: np.zeros(2 * lm_scoring.SIGNS)), defaultdict(int)
    for _, t, *_ in ROWS:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        data = np.frombuffer(b" ".join(words), np.uint8)
        at = lm_scoring.buckets_of(data, np.array([0, len(data)]), 0, 1)[0].tolist() if words else []
        for k, x in enumerate(at):
            n[x] += 1
            if k:
                want[x][: lm_scoring.SIGNS] += signs[:, at[k - 1]]
            if k + 1 < len(at):
                want[x][lm_scoring.SIGNS :] += signs[:, at[k + 1]]
    assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == dict(n)
    assert all((near[k] == want[k]).all() for k in n) and not near[counts == 0].any()
    # two uses far apart fall into different halves; the halves weigh the same
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.1, (400, 4)) + np.where(np.arange(400) % 2, 3, -3)[:, None]
    label = lm_scoring.halved(x, np.ones(400), 4)
    assert set(label[::2].tolist()) in ({0, 1}, {2, 3}) and not set(label[::2].tolist()) & set(label[1::2].tolist())
    assert np.bincount(label).tolist() == [100] * 4
    assert lm_scoring.halved(np.zeros((0, 4)), np.zeros(0), 4).tolist() == []
    assert set(lm_scoring.vocabulary(counts * 0, near * 0).class_of.tolist()) == set(range(lm_scoring.CLASSES))


def test_lm_scores_are_sums_of_conditional_log_probabilities(spark, docs):
    vocab, net = lm_scoring.train(docs, stride=1)
    rows = {r.doc_id: r for r in lm_scoring.score(docs, vocab, net, keep=["doc_id"]).collect()}
    for i, t, *_ in ROWS:
        if i == 10 or i == 11:
            continue
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())
        r = rows[i]
        assert r.n_tokens == len(words) and (r.mean_logp is None) == (not words)
        data = np.frombuffer(b" ".join(words), np.uint8)
        at, _ = lm_scoring.buckets_of(data, np.array([0, len(data)]), 0, 1) if words else ([], 0)
        total = 0.0
        for k in range(len(at)):
            h = np.zeros(lm_scoring.HIDDEN)
            for p, d in enumerate(lm_scoring.PLACES):
                h += net.emb[p][vocab.class_of[at[k + d]] if 0 <= k + d < len(at) else lm_scoring.PAD]
            z = np.tanh(h) @ net.out + net.bias
            c = vocab.class_of[at[k]]
            total += z[c] - np.log(np.exp(z).sum()) + vocab.logp_in_class[at[k]]
        assert r.logp == pytest.approx(total, rel=1e-3, abs=1e-3)
    assert lm_scoring.score(docs.limit(0), vocab, net, keep=[]).count() == 0
    assert lm_scoring.train(docs.limit(0))[1].bias.shape == (lm_scoring.CLASSES,)


def test_every_token_is_a_training_target(spark):
    texts = [f"rare{i} one two three four five" for i in range(300)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    vocab, net = lm_scoring.train(frame)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at, first = lm_scoring.buckets_of(data, np.cumsum([0, *map(len, texts)]), 0, len(texts))
    want, cls = lm_scoring.Network.first(vocab.class_logp), vocab.class_of[at]
    want.train(lm_scoring.contexts(cls, first), cls)
    assert len(cls) == 1800 and net.flat() == pytest.approx(want.flat(), abs=1e-5)


def test_training_raises_the_pseudo_likelihood(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    vocab, net = lm_scoring.train(frame, stride=4)
    trained, first = (lm_scoring.score(frame, vocab, m, keep=[]).selectExpr("avg(mean_logp)").first()[0] for m in (net, lm_scoring.Network.first(vocab.class_logp)))
    assert trained > first + 0.05


# ------------------------------------------------------------------ 8


def test_url_filters(spark):
    urls = ["http://www.Example.com/en/71?x", "https://example.com", "ftp://a.com/en/", "http://com/en/x", "http://bigexample.com/en/7", "https://x.example.net/de/8/9", "https://example.net/de/7", "http://q.org/es/#f", None, "no scheme", "", "http:///path", "http://EXAMPLE.ORG/en", "http://a.b.c.net/de/?", "https://u:p@h.com/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] * 2 + [(None, "http://x.com/en/q")]
    rules = [*url_filters.RULES, ("c.net", "/", "block"), ("c.net", "/", "allow")]

    def brute(u):
        if not u or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.lower()
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return host, path, *(max(fit)[3:] if fit else (None, "allow"))

    pages = spark.createDataFrame(rows, "page_id long, url string")
    frame = spark.createDataFrame(rules, "host string, path string, verdict string")
    for n in (1, 2, 7):
        got = url_filters.judge(pages, frame, ["page_id"], partitions=n).collect()
        assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got) == Counter((i, *brute(u)) for i, u in rows)
    assert url_filters.judge(pages.limit(0), frame, ["page_id"]).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, frame.limit(0), ["page_id"]).collect()} == {"allow"}


def test_hot_urls_are_dealt_over_buckets(spark):
    urls = [None] * 3000 + ["http://hot.example.com/en/7"] * 3000 + [f"http://h{i}.net/de/{i}" for i in range(3000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(5)
    rules = spark.createDataFrame([("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/1", "block"), ("hot.example.com", "", "block")], "host string, path string, verdict string")
    out = url_filters.judge(pages, rules, ["page_id"], partitions=12)
    assert Counter((r.rule, r.verdict) for r in out.collect()) == {(None, "allow"): 3000 + 3000 - 1111, ("net/de/1", "block"): 1111, ("example.com/en/7", "allow"): 3000}
    sizes = sorted(r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert len(sizes) >= 11 and sizes[-1] < 3 * sizes[len(sizes) // 2]


# ------------------------------------------------------------------ 10


def test_media_digests(spark, docs):
    for r in media.text_columns(docs, ["doc_id"], with_media=True).collect():
        raw = ({x[0]: x[1] for x in ROWS}[r.doc_id] or "").encode()
        padded = raw + bytes(-len(raw) % 64) if raw else bytes(64)
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(padded), zlib.crc32(padded[-64:]))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
        assert media.decode(bytes(r.media)).tobytes() == padded
    assert media.text_columns(docs.limit(0), ["doc_id"]).count() == 0


def test_media_formats_round_trip():
    rng = np.random.default_rng(0)
    for shape in [(1, 1), (5, 7), (3, 4, 3), (8, 5, 3)]:
        a = rng.integers(0, 256, shape).astype(np.uint8)
        assert (media.decode(media.encode_netpbm(a)) == a).all() and (media.decode(media.encode_bmp(a)) == a).all()
    assert media.decode(b"P2 # c\n2 1\n15\n0 15\n").tolist() == [[0, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    for bad in (b"", b"P5\n9 9\n255\nx", b"GIF89a", b"BM", b"P5 0 4 255\n", b"P2 1 1 255 70000", b"P2 1 1 255 -1", b"P5 99999999999 99999999999 255 x", b"P5 1 1 9 \xff"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_two_byte_samples_and_small_palettes():
    assert media.decode(b"P5\n2 1\n65535\n" + bytes((0, 0, 255, 255))).tolist() == [[0, 255]]
    assert media.decode(b"P6 1 1 1023\n" + b"".join(x.to_bytes(2, "big") for x in (0, 512, 1023))).tolist() == [[[0, 128, 255]]]
    assert media.decode(b"P2 2 1 1000\n0 1000").tolist() == [[0, 255]]
    for depth in (1, 4):
        a = np.arange(22).reshape(2, 11) * 7 % (1 << depth)
        palette = b"".join(bytes((3 * i, 5 * i, 7 * i, 0)) for i in range(1 << depth))
        rows = [np.packbits((x[:, None] >> np.arange(depth - 1, -1, -1)) & 1).tobytes() for x in a[::-1]]
        body = b"".join(x + bytes(-len(x) % 4) for x in rows)
        info = b"".join(x.to_bytes(n, "little") for x, n in ((40, 4), (11, 4), (2, 4), (1, 2), (depth, 2), (0, 4), (0, 4), (0, 4), (0, 4), (0, 4), (0, 4)))
        raw = b"BM" + bytes(8) + (54 + len(palette)).to_bytes(4, "little") + info + palette + body
        assert (media.decode(raw) == a[:, :, None] * np.array([7, 5, 3])).all()


def test_area_resize_equals_brute_force():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (11, 7)).astype(np.uint8)
    fine = np.repeat(np.repeat(a.astype(float), 8, 0), 9, 1)  # 88 x 63
    want = fine.reshape(8, 11, 9, 7).mean((1, 3))
    assert np.abs(media.resize(a, 8, 9).astype(float) - want).max() <= 0.5 + 1e-6


def test_mutated_images_are_decoded_or_refused(spark):
    rng = np.random.default_rng(5)
    a, colour = rng.integers(0, 256, (5, 7)).astype(np.uint8), rng.integers(0, 256, (4, 3, 3)).astype(np.uint8)
    seeds = [media.encode_netpbm(a), media.encode_bmp(a), media.encode_netpbm(colour), media.encode_bmp(colour), b"P2\n3 2\n15\n1 2 3 4 5 15", b"P1\n3 1\n1 0 1", b"P3 1 1 9 1 2 3", b"P4\n9 1\n\xff\x80"]
    images = []
    for k in range(10_000):
        raw = bytearray(seeds[k % len(seeds)])
        for _ in range(int(rng.integers(1, 5))):
            at = int(rng.integers(0, max(1, min(len(raw), 60))))
            kind = int(rng.integers(0, 4))
            if kind == 0 and raw:
                raw[at] = int(rng.integers(0, 256))
            elif kind == 1:
                raw[at : at + 1] = bytes(rng.choice(list(b"0123456789- #\n"), 2).tolist())
            elif kind == 2:
                del raw[at : at + int(rng.integers(1, 9))]
            else:
                raw += bytes(3)
        images.append(bytes(raw))
    for raw in images:
        try:
            out = media.decode(raw)
        except ValueError:
            continue
        assert out.size and len(media.npy_tile(out)) and len(media.difference_hash(out)) == 16
    df = spark.createDataFrame([(i, x) for i, x in enumerate(images[:500] + [b"P5 0 4 255\n", b"P2 1 1 255 -1"])], "id long, image binary")
    rows = media.decode_column(df, "image", ["id"]).collect()
    assert len(rows) == 502 and {r.dhash for r in rows if r.id >= 500} == {None}
    assert media.write_tiles(df, "image", "id")[0].where("file IS NULL AND id >= 500").count() == 2


def test_media_column_gives_null_for_unreadable(spark):
    good = media.encode_bmp(np.arange(48, dtype=np.uint8).reshape(4, 12))
    rows = media.decode_column(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"x")), (3, None)], "id long, image binary"), "image", ["id"]).orderBy("id").collect()
    assert (rows[0].height, rows[0].width, rows[0].channels) == (4, 12, 1) and rows[1].dhash is None and rows[2].tile is None


# ------------------------------------------------------------------ clashing names


def test_added_names_that_are_taken(spark):
    names = ["copy", "copies", "rate", "shuffle_key", "ids", "score", "lang_pred", "n_tokens", "LOGP", "n_bytes", "counts", "feature", "node", "component", "key", "row"]
    docs = spark.createDataFrame([(i, f"some words of text {i}", "en", "s", *[f"{n}{i}" for n in names]) for i in range(4)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    model = language_id.train(docs)
    nothing = lm_scoring.vocabulary(np.zeros(lm_scoring.BUCKETS), np.zeros((lm_scoring.BUCKETS, 2 * lm_scoring.SIGNS)))
    keep = docs.columns
    outs = {
        "shuffle_key_": mixing.mix(docs), "lang_pred_": language_id.identify(docs, model, keep=keep), "n_tokens_": lm_scoring.score(docs, nothing, lm_scoring.Network.first(nothing.class_logp), keep),
        "counts_": token_counts.count_tokens(docs, keep), "feature_": media.text_columns(docs, keep), "ids_": piece_lattice.encode_documents(docs, keep),
    }
    for name, out in outs.items():
        assert name in out.columns and len({c.lower() for c in out.columns}) == len(out.columns)
        assert out.columns[: len(keep)] == keep and all(r["ids"] == f"ids{r.doc_id}" and r["copy"] == f"copy{r.doc_id}" for r in out.collect())
    for same in (exact_dedup.dedup(docs), ngram_jaccard.dedup_near(docs), language_id.accept(docs, model)):
        assert same.columns == keep and same.count() >= 1
    pages = spark.createDataFrame([(1, "http://a.com/en/", "h", "p", "v")], "page_id long, url string, host string, path string, verdict string")
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, verdict string")
    got = url_filters.judge(pages, rules, ["page_id", "host", "path", "verdict"]).first().asDict()
    assert got == dict(page_id=1, host="h", path="p", verdict="v", host_="a.com", path_="/en/", rule="com/en/", verdict_="block")


def test_tiles_are_written(spark, tmp_path):
    rng = np.random.default_rng(3)
    images = [rng.integers(0, 256, (20 + i, 30) if i % 2 else (20 + i, 30, 3)).astype(np.uint8) for i in range(9)]
    rows = [(i, media.encode_bmp(a) if i % 3 else media.encode_netpbm(a)) for i, a in enumerate(images)] + [(50, b"none"), (51, None)]
    df = spark.createDataFrame(rows, "doc_id long, image binary").repartition(2)
    got, folder = media.write_tiles(df, "image", "doc_id", str(tmp_path / "tiles"))
    got = {r.id: r for r in got.collect()}
    assert len(got) == 11 and got[50].file is None and got[51].place is None
    for i, a in enumerate(images):
        assert (np.load(f"{folder}/{got[i].file}")[got[i].place] == media.resize(a, 16, 16)).all()
    assert all(x.startswith("tiles-") for x in os.listdir(folder))
    assert media.write_tiles(df.limit(0), "image", "doc_id", str(tmp_path / "none"))[0].count() == 0
