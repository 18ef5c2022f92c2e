"""The source scanner against a machine that reads one character at a time."""

import random
from collections import Counter

import pytest

from sluice.operators import parsers


def machine(source, python):
    """(code lines, comment lines, blank lines): states are None, 'block' or the quotes that close a docstring."""
    state, code, comment, blank = None, [], 0, 0
    for line in source.splitlines():
        if not line.strip():
            blank += 1
            continue
        chars, has_code, has_comment, literal, quote = list(line), False, False, False, None
        fresh = python
        while chars or (fresh and not state):
            if state:
                has_comment = True
                fresh = python
                end = "*/" if state == "block" else state
                if "".join(chars[: len(end)]) == end:
                    del chars[: len(end)]
                    state = None
                    continue
                del chars[0]
                continue
            if fresh:
                fresh = False
                rest = "".join(chars).strip()
                for n in range(3):
                    if set(rest[:n].lower()) <= set("rubf") and rest[n : n + 3] in ('"""', "'''"):
                        has_comment, state = True, rest[n : n + 3] if rest.count(rest[n : n + 3]) < 2 else None
                        chars = []
                        break
                if not chars:
                    break
                continue
            c = chars.pop(0)
            if quote:
                if c == "\\" and chars:
                    del chars[0]
                elif c == quote:
                    quote = None
            elif c in "'\"":
                quote, literal = c, True
            elif python and c == "#" or not python and c == "/" and chars[:1] == ["/"]:
                has_comment, chars = True, []
            elif not python and c == "/" and chars[:1] == ["*"]:
                has_comment, state = True, "block"
                del chars[0]
            elif not c.isspace():
                has_code = True
        if has_code:
            code.append(line)
        elif has_comment:
            comment += 1
        elif not literal:
            blank += 1
    return code, comment, blank


PIECES = ["x", " ", "\n", "\n", "/*", "*/", "//", "/", "*", '"', "'", "\\", "#", '"""', "'''", "r", "= 1;", "\t", "\r\n", " ", "\x01", "é"]


@pytest.mark.parametrize("language", ["java", "python"])
def test_scanner_is_the_machine(language):
    rng = random.Random(11)
    for _ in range(20_000):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25)))
        assert parsers.scanned_lines(text, language) == machine(text, language == "python"), repr(text)


def test_mixed_lines():
    assert parsers.comment_lines("int x; /* a\n b\n c */\n int y;", "c++") == (2, 2, 0)
    assert parsers.comment_lines("/* a */ int x;", "java") == (1, 0, 0)
    assert parsers.comment_lines('s = "/*"; // no block\n"*/"\ny', "c") == (2, 0, 0)
    assert parsers.comment_lines("r'''doc\nmore\n\nend''' + 1", "python") == (1, 2, 1)
    assert parsers.scanned_lines(None, "java") == ([], 0, 0) and parsers.scanned_lines("\n\n", None) == ([], 0, 2)
    assert parsers.comment_lines("", "java") == (0, 0, 1) and parsers.comment_lines("\n\n", None) == (0, 0, 3)


def test_duplication_over_the_files_of_a_snapshot(spark):
    rows = [(1, "a", "x = 1;\n  x  =\t1;\n// x = 1;\n", "java"), (2, "a", "x = 1;", "java"), (3, "b", '"only"\n/* c */', "c"), (4, None, "y\ny\n# y\n", "python"), (5, "b", None, "c"), (6, "c", "", None)]
    df = spark.createDataFrame(rows, "id long, snap string, text string, lang string")
    got = {r.snap: (r.files, r.ncloc, r.duplicated, r.density) for r in parsers.code_duplication(df, "snap", "text", "lang").collect()}
    assert got == {"a": (2, 3, 2, pytest.approx(200 / 3)), "b": (2, 0, 0, 0.0), None: (1, 2, 1, 50.0), "c": (1, 0, 0, 0.0)}
    counts = Counter(tuple(r)[1:] for r in parsers.source_lines(df, ["id"], "text", "lang").collect())
    assert counts == Counter([(2, 1, 0), (1, 0, 0), (0, 1, 0), (2, 1, 0), (0, 0, 0), (0, 0, 0)])
