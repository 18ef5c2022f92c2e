"""Operation retention from contents against plain searches."""

import random

from sluice.operators import retention


def test_found_elements():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abcé ") for _ in range(rng.randint(0, 60)))
        elements = sorted({"".join(rng.choice("abcé ") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))})
        assert retention.found_elements(text, elements) == [e in text for e in elements]
    assert retention.found_elements(None, ["a"]) == [False]


def test_retained_operations(spark):
    rng = random.Random(6)
    texts = {(s, f"p{i}"): None if i == 3 else " ".join(rng.choice(["foo()", "bar(x)", "class A", "int y", "zed"]) for _ in range(i)) for s in ("1m", "1y") for i in range(9) if (s, i) != ("1y", 5)}
    renames = {("1m", "old"): "p2", ("1y", "p1"): "p8"}
    rows = []
    for op in range(60):
        for _ in range(rng.randint(1, 4)):
            rows.append((op, ("1m", "1y", "lost")[op % 3], rng.choice(["p1", "p2", "p3", "p5", "old", "gone", None]), rng.choice([" foo() ", "bar(x)", "class A\n", "absent", "", None, "x) c"])))
    rows += [(99, "1m", "p4", f"e{i}") for i in range(50)] + [(99, "1m", "p4", "zed")]
    one = lambda data, kind: spark.createDataFrame(data, kind)
    frames = (
        one(rows, "op int, snapshot string, path string, element string"),
        one([(*k, t) for k, t in texts.items()], "snapshot string, path string, text string"),
        one([("1m",), ("1y",)], "snapshot string"),
        one([(*k, v) for k, v in renames.items()], "snapshot string, path string, renamed string"),
    )
    got = {(r.op, r.snapshot): (r.checked, r.file_matches, r.exact_matches, r.status) for r in retention.retained_operations(*frames, ["op"]).collect()}
    want = {}
    for op, s, p, e in rows:
        c, f, x = want.setdefault((op, s), [0, 0, 0])
        p = renames.get((s, p), p)
        if s != "lost" and p is not None:
            c, there = c + 1, (s, p) in texts
            f += there
            x += bool(there and (e or "").strip() and (e or "").strip() in (texts[s, p] or ""))
        want[op, s] = [c, f, x]
    status = lambda c, f, x: "unknown" if not c else "retained" if x else "weakly_retained" if f else "not_retained"
    assert got == {k: (*v, status(*v)) for k, v in want.items()}
    parts = retention.locate(*frames[:2], "snapshot", "path", "element", "text", most=7).where("path = 'p4'")
    assert parts.count() == len({e for _, s, p, e in rows if (s, p) == ("1m", "p4") and e})
