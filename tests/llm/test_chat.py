"""Operator 13: windows against a plain walk through the turns, and what is read back from them."""

import hashlib
import itertools

import pytest

from sluice.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted int"
HARD = ["\\### Assistant: </turn> ok", "<turn user>", "\\l\\b\\\\<", "</turn", ">", "a\n\nb", "é日本😀", ""]


def rows():
    out = [(1, k, r, t) for k, (r, t) in enumerate(itertools.product(("user", "assistant"), HARD))]
    out += [(2, 0, "system", "be brief"), (2, 1, "user", "u" * 4000), (2, 2, "assistant", "a" * 9000), (2, 3, "user", "end")]
    out += [(3, 0, "system", "s" * 6000), (3, 1, "user", "hello"), (3, 2, "assistant", "x" * 5000)]
    out += [(4, 5, "assistant", None), (4, None, None, "no number"), (4, 5, "assistant", None), (4, 5, "system", "late")]
    out += [(None, 0, "user", "who"), (None, 1, "assistant", "nobody")]
    out += [(5, 0, "system", "only me")]
    out += [(6, k, ("user", "assistant", "we<i>rd\\")[k % 3], "w" * (k * 37 % 700)) for k in range(-700, 1500)] + [(6, -701, "system", "long talk")]
    return out


def cost(text):
    return 4 + -(-len(text.encode()) // 4)


def escaped(t, role=False):
    t = t.replace("\\", "\\b").replace("<", "\\l")
    return t.replace(">", "\\g") if role else t


def walk(data, budget, history):
    """{conv: [(code, repeated, new)]}, a turn being (role, text), by a plain walk."""
    convs = {}
    for c, k, r, t in data:
        convs.setdefault(c, []).append((k is not None, k or 0, (r or "") != "system", r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        turns = [(r, t) for *_, r, t in sorted(turns)]
        system = turns[0] if turns[0][0] == "system" and cost(turns[0][1]) <= budget // 2 else None
        room = budget - history - (cost(system[1]) if system else 0)
        at, spans = 0, {}
        if system:
            spans[0] = [(0, system)]
        for role, text in turns[1 if system else 0 :]:
            end = at + cost(text)
            spans.setdefault(at // room * 2 + ((end - 1) // room != at // room), []).append((at, (role, text)))
            at = end
        out[c], before = [], []
        for code in sorted(spans):
            own = spans[code]
            leads = system is not None and own[0][1] is system
            recent = [t for s, t in before if s >= own[0][0] - history]
            out[c].append((code, ([system] if system and not leads else []) + recent, [t for _, t in own]))
            before += [x for x in own if x[1] is not system]
    return out


def rendered(turn):
    return f"<turn {escaped(turn[0], True)}>{escaped(turn[1])}</turn>"


@pytest.mark.parametrize("budget, history", [(1024, 256), (200, 50), (64, 0)])
def test_windows(spark, budget, history):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], SCHEMA).repartition(3)
    windows = chat.format_conversations(df, budget, history)
    want = walk(data, budget, history)
    got = {}
    for r in chat.read_turns(windows).collect():
        got.setdefault(r.conv_id, {})[r.window] = r
    assert got.keys() == want.keys()
    for c, spans in want.items():
        assert sorted(got[c]) == [code for code, *_ in spans]
        for code, repeated, new in spans:
            r = got[c][code]
            assert r.formatted == "".join(map(rendered, repeated + new))
            assert (r.n_repeated, r.n_turns) == (len(repeated), len(new))
            assert [(t.role, t.text) for t in r.turns] == new
            assert list(r.loss) == [t for role, t in new if role == "assistant"]
            assert r.tokens == sum(cost(t) for _, t in repeated + new) and r.over_budget == (r.tokens > budget)
            assert not r.over_budget or len(new) == 1


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], SCHEMA)
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(df)).collect()}
    want = walk(data, chat.BUDGET, chat.HISTORY)
    assert got.keys() == want.keys()
    for c, spans in want.items():
        turns = [t for _, _, new in spans for t in new]
        loss = "".join(t for role, t in turns if role == "assistant")
        chars = sum(len(rendered(t)) for _, repeated, new in spans for t in repeated + new)
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256, r.formatted_chars) == (len(loss), sha(loss), chars)
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_only_expressions(spark):
    df = spark.createDataFrame([(*r, 1) for r in rows()[:5]], SCHEMA)
    plan = chat.digests(chat.format_conversations(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
