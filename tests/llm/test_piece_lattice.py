import random

import numpy as np
import pytest

from sluice.llm import piece_lattice as pl

V = pl.vocabulary()


def brute(seg):
    """All segmentations of a segment, (score, ids), best first."""
    edges = pl.edges_of(V, seg)

    def back(at):
        if at == 0:
            yield 0.0, []
            return
        for start, score, ids in edges[at]:
            for g, head in back(start):
                yield g + score, head + list(ids)

    return sorted(back(len(seg)), key=lambda x: (-x[0], len(x[1])))


@pytest.mark.parametrize("seg", ["▁the", "▁anoni", "▁éeaux", "▁x\ny", "▁▁a", "▁日本", "▁a" + pl._SENTINEL])
def test_a_star_pops_the_best_of_all_segmentations(seg):
    want = brute(seg)[:6]
    got = pl.n_best(V, seg, 6)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert len({tuple(g[1]) for g in got}) == len(got)


def test_batched_forward_pass_equals_brute_force():
    rng = random.Random(3)
    segs = ["▁" + "".join(rng.choice("thinedoré\n▁"[:9]) for _ in range(rng.randint(0, 7))) for _ in range(60)] + ["▁" + "ab" * 60, "日"]
    lat = pl.Lattices(V, segs)
    for i, s in enumerate(segs):
        if len(s) < 12:
            want = brute(s)
            assert lat.best[i] == want[0][0] and len(lat.ids[i]) == len(want[0][1])
            assert lat.loss[i] == (want[0][0] - want[1][0] if len(want) > 1 else np.inf)
        assert pl.decode_batch(lat.ids[i], np.array([0, len(lat.ids[i])]), V)[0] is not None


TEXTS = ["", None, " ", "a", "Hello  wörld\nx", "▁ mark ▁▁", "▁", "日本 語", "a" * 3000, " lead and trail ", "tab\tx \n\n y", "\x00\x7f", "the the the", "emoji 😀 x"]


def test_round_trip_and_document_n_best():
    enc = pl.Encoder()
    for t, got in zip(TEXTS, enc.encode(TEXTS, 4)):
        if t is None:
            assert got is None
            continue
        ids, score, losses, changed = got
        assert pl.decode(ids.tolist(), V) == t
        assert losses == sorted(losses)
        segs = pl.segments(t) if t else []
        if segs and sum(map(len, segs)) < 16:
            # n best of the whole text, from all combinations of its segments
            alts = [[w for w in brute(s)][:8] for s in segs]
            sums = [0.0]
            for a in alts:
                sums = sorted((x + a[0][0] - w[0] for x in sums for w in a))[:8]
            assert losses == pytest.approx(sums[1:4])
    a, b = list(enc.encode(["the cat", "the cat"], 3))
    assert a[0].tolist() == b[0].tolist()


def test_encode_documents_keeps_nulls_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "q"), (None, None, None), (1, "a b", "q"), (3, "", "x")], "doc_id long, text string, ids string")
    rows = pl.encode_documents(docs, ["doc_id"]).collect()
    by = {(r.doc_id, r.ids is None): r for r in rows}
    assert len(rows) == 4 and by[None, True].n_pieces is None and by[3, False].ids == []
    assert all(r.restored for r in rows if r.ids is not None)
    assert pl.encode_documents(docs.limit(0), ["doc_id"]).count() == 0
