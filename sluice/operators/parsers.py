"""Reports, diffs and sources as rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import NO_REFACTORING
from .ranks import match

DIFF = "path string, side string, start int, end int"
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff_ranges(text: str | None) -> list[tuple[str, str, int, int]]:
    """(path, side, start, end) of the changed lines of a unified diff: removed on the old side, added on the new; a
    hunk without lines on a side is an anchor of that side with end = start - 1."""
    out, old, new, a, b = [], None, None, 0, 0
    runs: dict[str, list[int]] = {}

    def put(side: str, path: str | None, line: int) -> None:
        run = runs.get(side)
        if run and run[2] == path and line == run[1] + 1:
            run[1] = line
        else:
            flush(side)
            runs[side] = [line, line, path]

    def flush(side: str) -> None:
        run = runs.pop(side, None)
        if run and run[2]:
            out.append((run[2], side, run[0], run[1]))

    strip = lambda p: None if p == "/dev/null" else re.sub("^[ab]/", "", p)
    left = right = 0
    for line in (text or "").split("\n"):
        if left <= 0 and right <= 0:
            if line.startswith("--- "):
                old = strip(line[4:].split("\t")[0].strip())
                continue
            if line.startswith("+++ "):
                new = strip(line[4:].split("\t")[0].strip())
                continue
        if m := _HUNK.match(line):
            flush("old"), flush("new")
            a, left, b, right = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            for side, path, at, n in (("old", old, a, left), ("new", new, b, right)):
                if not n and path:
                    out.append((path, side, at + 1, at))
        elif line.startswith("-") and left > 0:
            put("old", old, a)
            a, left = a + 1, left - 1
        elif line.startswith("+") and right > 0:
            put("new", new, b)
            b, right = b + 1, right - 1
        elif line.startswith(" ") and left > 0:
            flush("old"), flush("new")
            a, b, left, right = a + 1, b + 1, left - 1, right - 1
    flush("old"), flush("new")
    return out


def parse_diffs(df: DataFrame, keep: list[str], diff: str) -> DataFrame:
    """A row per changed range; the parse keeps a state over lines, so it runs in Arrow batches."""

    def run(batches):
        for pdf in batches:
            rows = [(*k, *r) for *k, d in pdf.itertuples(index=False, name=None) for r in diff_ranges(d)]
            yield pd.DataFrame(rows, columns=[*keep, "path", "side", "start", "end"])

    held = df.select(*keep, F.col(diff).alias("__diff"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    return held.mapInPandas(run, f"{schema}, {DIFF}" if schema else DIFF)


def line_report(df: DataFrame, keep: list[str], report: str, pattern: str, fields: list[str]) -> DataFrame:
    """Findings of a line-oriented report: one row a line that fits the pattern, its groups as fields."""
    lines = df.select(*keep, F.explode(F.split(report, r"\r?\n")).alias("__l")).where(F.col("__l").rlike(pattern))
    return lines.select(*keep, *[F.regexp_extract("__l", pattern, i + 1).alias(f) for i, f in enumerate(fields)])


#: file:line:column: severity: message [rule]
COMPILER_LINE = r"^(.+?):(\d+):(?:(\d+):)?\s*(error|warning|style|performance|portability|information|note):\s*(.*?)\s*(?:\[([\w.,-]+)\])?$"


def compiler_findings(df: DataFrame, keep: list[str], report: str) -> DataFrame:
    out = line_report(df, keep, report, COMPILER_LINE, ["path", "line", "column", "severity", "message", "rule"])
    return out.withColumn("line", F.col("line").cast("int")).withColumn("column", F.col("column").try_cast("int"))


def json_findings(df: DataFrame, keep: list[str], report: str, schema: str, path: str) -> DataFrame:
    """Findings of a JSON report: the array of structs at a path, one row each, with the struct's fields."""
    parsed = df.select(*keep, F.from_json(report, schema).alias("__r"))
    return parsed.select(*keep, F.explode(F.col(f"__r.{path}" if path else "__r")).alias("f")).select(*keep, "f.*")


_LOCATION = "struct<filePath:string,startLine:int,endLine:int,codeElement:string>"
_SIDES = ", ".join(f"{x}:array<{_LOCATION}>" for x in ("leftSideLocations", "rightSideLocations", "beforeLocations", "afterLocations"))
_OPERATION = f"struct<type:string,relationshipType:string,description:string,standardDescription:string,commitId:string,commit:string,{_SIDES}>"
_REPORT = f"commits array<struct<sha1:string,commitId:string,commit:string,refactorings:array<{_OPERATION}>>>, refactorings array<{_OPERATION}>, relationships array<{_OPERATION}>"

# The operation names that a text report's lines begin with, in the order they are tried.
TEXT_OPERATIONS = ["Change Signature of Method/Function", "Extract Method/Function", "Inline Method/Function", "Extract Supertype", "Move and Rename", "Pull Up Method", "Push Down Method", "Convert Type", "Rename", "Move"]


def tool_operations(df: DataFrame, keep: list[str], payload: str, commit: str | None = None) -> DataFrame:
    """Operations of a JSON report (by commits, as refactorings, as relationships, or a bare list), one row each:
    index, raw_type, description, commit_id, source and target locations. Relationships of type Same are none."""
    whole, bare = F.from_json(payload, _REPORT), F.from_json(payload, f"array<{_OPERATION}>")
    given = F.col(commit) if commit else F.lit(None).cast("string")
    tag = lambda ops, sha: F.transform(ops, lambda o: F.struct(sha.alias("sha"), o.alias("o")))
    by_commit = F.flatten(F.transform(whole["commits"], lambda c: tag(F.coalesce(c["refactorings"], F.array().cast(f"array<{_OPERATION}>")), F.coalesce(c["sha1"], c["commitId"], c["commit"]))))
    none = F.lit(None).cast("string")
    is_list = F.trim(payload).startswith("[")
    all_ops = F.when(is_list, tag(bare, none)).otherwise(F.coalesce(by_commit, tag(whole["relationships"], none), tag(whole["refactorings"], none)))
    kept = F.filter(all_ops, lambda x: ~F.lower(F.trim(F.coalesce(x["o"]["type"], x["o"]["relationshipType"], F.lit("")))).isin(*NO_REFACTORING))
    o = F.col("x.o")
    rows = df.select(*keep, given.alias("__given"), F.posexplode(kept).alias("index", "x"))
    return rows.select(
        *keep, "index", F.coalesce(o["type"], o["relationshipType"]).alias("raw_type"), F.coalesce(o["description"], o["standardDescription"]).alias("description"), F.coalesce("x.sha", o["commitId"], o["commit"], "__given").alias("commit_id"),
        F.coalesce(o["leftSideLocations"], o["beforeLocations"]).alias("source_locations"), F.coalesce(o["rightSideLocations"], o["afterLocations"]).alias("target_locations"),
    )


def text_operations(df: DataFrame, keep: list[str], report: str) -> DataFrame:
    """Operations of a text report: each line but the heading, with the operation name it begins with."""
    lines = F.filter(F.transform(F.split(report, r"\r?\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.startswith("Refactorings found in "))
    raw = F.lit(None).cast("string")
    for name in reversed(TEXT_OPERATIONS):
        raw = F.when(F.col("description").startswith(name), name).otherwise(raw)
    return df.select(*keep, F.posexplode(lines).alias("index", "description")).withColumn("raw_type", raw)


BLOCKS = "index int, raw_type string, description string"
#: Lines of a block report that say nothing about an operation.
_NOISE = re.compile(r"the following refactorings were detected|the following lines of the current version|lines changed in total|=|\d+$|$", re.I)


def block_operations_of(text: str | None) -> list[tuple[int, str, str]]:
    """Operations of a report in blocks: numbered blocks `1)` between the heading of detected refactorings and that of
    functionality changes or the summary. A block's first line has the type, parted from the description by a tab or two
    spaces; later lines go on with it."""
    lines = [x.strip() for x in (text or "").splitlines()]
    heads = [i for i, x in enumerate(lines) if "detected refactorings" in x.lower()]
    if not heads:
        return []
    body = [x for x in lines[heads[0] :] if "detected refactorings" not in x.lower()]
    end = next((i for i, x in enumerate(body) if "detected functionality changes" in x.lower() or x.lower().startswith("summary")), len(body))
    blocks: list[list[str]] = [[]]
    for x in body[:end]:
        if re.fullmatch(r"\d+\)", x):
            blocks.append([])
        elif not _NOISE.match(x):
            blocks[-1].append(x)
    out = []
    for i, (head, *rest) in enumerate(b for b in blocks if b):
        kind, _, said = head.partition("\t") if "\t" in head else head.partition("  ")
        out.append((i, kind.strip() or head, " ".join([said.strip() or head, *rest])))
    return out


DESIGN = "smell string, category string, severity string, path string, line int, column int, message string"
_DESIGN = [("smell", "name", "rule", "type"), ("category", "smellCategory", "level"), ("severity", "priority"), ("file", "filePath", "path"), ("line", "startLine", "beginLine"), ("column", "startColumn", "beginColumn"), ("description", "message", "details")]
_CHILDREN = ("smells", "issues", "violations", "results", "data", "items")


def design_findings_of(text: str | None) -> list[tuple]:
    """Findings of a nested design report: an object's child lists and objects, at any depth, stand for it; an object without a
    smell is none."""
    try:
        todo, out = [json.loads(text or "")], []
    except ValueError:
        return []
    while todo:
        x = todo.pop()
        if isinstance(x, list):
            todo += reversed(x)
        elif isinstance(x, dict):
            inner = [x[c] for c in _CHILDREN if isinstance(x.get(c), (list, dict))]
            if inner:
                todo += reversed(inner)
                continue
            f = [next((x[n] for n in names if x.get(n) not in (None, "")), None) for names in _DESIGN]
            if f[0]:
                number = [int(float(v)) if re.fullmatch(r"\d+(\.\d*)?", str(v)) else None for v in f[4:6]]
                out.append((str(f[0]), *[None if v is None else str(v) for v in f[1:4]], *number, str(f[6] or f[0])))
    return out


def _rows_of(df: DataFrame, keep: list[str], report: str, parse, schema: str) -> DataFrame:
    """A row per tuple that parse gives for a report; a parser with a state over lines runs in Arrow batches."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [(*k, *r) for *k, d in pdf.itertuples(index=False, name=None) for r in parse(d)]
            out = pd.DataFrame(rows, columns=[*keep, *names])
            yield out.astype({n: "Int32" for n, k in (f.split() for f in schema.split(", ")) if k == "int"})

    held = df.select(*keep, F.col(report).alias("__report"))
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1])
    return held.mapInPandas(run, f"{own}, {schema}" if own else schema)


def block_operations(df: DataFrame, keep: list[str], report: str) -> DataFrame:
    return _rows_of(df, keep, report, block_operations_of, BLOCKS)


def design_findings(df: DataFrame, keep: list[str], report: str) -> DataFrame:
    return _rows_of(df, keep, report, design_findings_of, DESIGN)


def eslint_severity(c):
    return F.when(F.col(c) == 1, "warning").when(F.col(c) == 2, "error").otherwise("unknown")


#: What ends a line.
_BREAK = re.compile("\r\n|[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
#: Comments and literals of C-like sources; a literal ends with its line, a block comment doesn't.
_C_TOKEN = re.compile(r"""/\*[\s\S]*?(?:\*/|\Z)|//[^\n]*|"(?:\\[^\n]?|[^"\\\n])*"?|'(?:\\[^\n]?|[^'\\\n])*'?""")
#: The same within a line of Python, and a line that starts with a triple quote.
_PY_TOKEN = re.compile(r"""#.*|"(?:\\.?|[^"\\])*"?|'(?:\\.?|[^'\\])*'?""")
_PY_DOC = re.compile(r"""[rRuUbBfF]{0,2}(\"{3}|'{3})""")
#: Marks of a comment and of a literal in a line whose tokens are taken out.
_COMMENT, _LITERAL = "\x01", "\x02"
_MARKS = str.maketrans({_COMMENT: "x", _LITERAL: "x"})


def _mark(m: re.Match) -> str:
    token = m[0]
    if token[0] == "#" or token[0] == "/":
        return "\n".join(_COMMENT if part.strip() else "" for part in token.split("\n"))
    return _LITERAL


def _marked_python(lines: list[str]) -> list[str]:
    out, inside = [], None
    for line in lines:
        marks = ""
        if inside and line.strip():
            before, closed, rest = line.partition(inside)
            marks, line = _COMMENT, rest if closed else ""
            if closed:
                inside = None
        doc = None if inside else _PY_DOC.match(line.strip())
        if doc:
            if line.count(doc[1]) < 2:
                inside = doc[1]
            marks, line = _COMMENT, ""
        out.append(marks + _PY_TOKEN.sub(_mark, line))
    return out


def scanned_lines(source: str | None, language: str | None) -> tuple[list[str], int, int]:
    """(lines with code, lines with comments alone, blank lines) of a source. Code is what stands outside of comments and
    literals, so a line that holds literals alone is in none of the three. Block comments and docstrings go on over lines."""
    text = _BREAK.sub("\n", source or "")
    lines = text.removesuffix("\n").split("\n") if text else []
    text = text.translate(_MARKS)
    marked = _marked_python(text.split("\n")) if (language or "").lower() == "python" else _C_TOKEN.sub(_mark, text).split("\n")
    code, comment, blank = [], 0, 0
    for line, seen in zip(lines, marked):
        if seen.replace(_COMMENT, "").replace(_LITERAL, "").strip():
            code.append(line)
        elif _COMMENT in seen:
            comment += 1
        elif _LITERAL not in seen:
            blank += 1
    return code, comment, blank


def comment_lines(source: str | None, language: str | None) -> tuple[int, int, int]:
    """(code, comment, blank) pieces of a source between its line ends: the one after the last end counts as blank, if empty."""
    code, comment, blank = scanned_lines(source, language)
    return len(code), comment, blank + (not source or _BREAK.sub("\n", source).endswith("\n"))


def source_lines(df: DataFrame, keep: list[str], source: str, language: str) -> DataFrame:
    """Lines of code, of comments alone and blank ones of each source; an end of the last line adds none."""

    @F.pandas_udf("struct<code:int,comment:int,blank:int>")
    def scan(s: pd.Series, lang: pd.Series) -> pd.DataFrame:
        rows = [scanned_lines(a, b) for a, b in zip(s, lang)]
        return pd.DataFrame([(len(code), comment, blank) for code, comment, blank in rows], columns=["code", "comment", "blank"])

    return df.select(*keep, scan(source, language).alias("__s")).select(*keep, "__s.*")


def code_duplication(df: DataFrame, key: str, source: str, language: str) -> DataFrame:
    """Per key (a snapshot of sources): files, non-comment lines of code, repeated ones (occurrences beyond the first) and
    their percentage. A line's spaces are made equal, names and literals are not. Lines are counted by (key, line) first, so
    a hot key is summed from its partial counts."""

    @F.pandas_udf("array<string>")
    def code(s: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([[" ".join(x.split()) for x in scanned_lines(a, b)[0]] for a, b in zip(s, lang)], dtype=object)

    lines = df.select(key, F.explode_outer(code(source, language)).alias("line"))
    per = lines.where("line IS NOT NULL").groupBy(key, "line").agg(F.count(F.lit(1)).alias("c"))
    sums = per.groupBy(key).agg(F.sum("c").alias("ncloc"), F.sum(F.col("c") - 1).alias("duplicated"))
    files = df.groupBy(key).agg(F.count(F.lit(1)).alias("files"))
    out = match(files, sums, [key], "left").fillna(0, ["ncloc", "duplicated"])
    density = F.when(F.col("ncloc") > 0, F.col("duplicated") * F.lit(100.0) / F.col("ncloc")).otherwise(F.lit(0.0))
    return out.select(key, "files", "ncloc", "duplicated", density.alias("density"))
