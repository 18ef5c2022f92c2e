"""The pipeline against a brute-force version of its stages on a small corpus."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline
from sluice.llm import piece_lattice

from .test_operators import LONG, BASE, brute_components, norm

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def corpus():
    rows = []
    for i in range(60):
        text = " ".join(WORDS[(i * 7 + k * (i % 5 + 1) + k * k) % 20] + str((i * k) % 13) for k in range(8 + i % 40))
        rows.append((i, text, "en" if i % 3 else "fr", f"s{i % 4}", len(text)))
    rows += [(100, BASE, "en", "s0", 1), (101, BASE + " extra", "en", "s1", 1), (102, "  " + BASE.replace(" ", "  "), None, "s0", 1), (103, LONG, "en", "s0", 1), (104, None, None, None, None), (105, "", "en", "s1", 0), (106, "12 34", "en", "s1", 5)]
    return rows + rows[:10]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    docs = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    groups = defaultdict(list)
    for r in docs:
        groups[norm(r[1])].append(r)
    docs = [min(g) for g in groups.values()]
    component = brute_components([r[:2] for r in docs])
    docs = [r for r in docs if component[r[0]][1] == r[0]]
    size = Counter(r[3] for r in docs)
    total = sum(math.sqrt(n) for n in size.values())
    want = Counter()
    for i, _, _, s, _ in docs:
        rate = len(docs) * math.sqrt(size[s]) / total / size[s]
        u = int(hashlib.md5(f"17:{i}:1".encode()).hexdigest()[:13], 16) / 2**52
        p = c = math.exp(-rate)
        k = 0
        while c <= u:
            k += 1
            p *= rate / k
            c += p
        if k:
            want[i] = k
    assert Counter(r.doc_id for r in got) == want
    text = {r[0]: r[1] for r in rows}
    assert all(piece_lattice.decode(r.ids) == text[r.doc_id] == r.text and r.restored for r in got)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame(corpus()[:20], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert re.fullmatch(r"language_id,exact_dedup,ngram_jaccard,source_mixing,sentencepiece", ",".join(n for n, _ in corpus_pipeline.STAGES))
