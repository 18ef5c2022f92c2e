"""Text and path expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EXTENSIONS
from .scalars import _col

# Characters of a text that are read per token of a limit, and at least.
WINDOW, LEAST_WINDOW = 200, 4096

# Endings of English plurals and what stands for them.
NOUN_ENDINGS = [("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")]


def infer_language(path) -> Column:
    """Language by the extension after the last dot of the last path part."""
    name = F.regexp_extract(_col(path), r"([^/\\]*)$", 1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    table = F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])
    return F.when(name.contains("."), F.element_at(table, ext))


def lookup_key(label) -> Column:
    """A refactoring label as a key: & is and, _ / - are spaces, other signs go, spaces collapse, lower case."""
    t = F.regexp_replace(F.regexp_replace(_col(label), "&", " and "), "[_/-]+", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, "[^A-Za-z0-9 ]+", "")), " +", " "))


def smell_lookup_key(label) -> Column:
    """A code-smell label as a key: _ - . / : are spaces, other signs go."""
    t = F.regexp_replace(_col(label), "[_./:-]+", " ")
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(t, "[^A-Za-z0-9 ]+", "")), " +", " "))


def is_named_type(label) -> Column:
    t = F.lower(F.trim(F.coalesce(_col(label), F.lit(""))))
    return ~t.isin("", "unclassified")


def split_identifier(c) -> Column:
    """Words of an identifier: camel case, acronyms, digits and delimiters are boundaries."""
    t = F.regexp_replace(_col(c), r"[^A-Za-z0-9]+", " ")
    for pattern in (r"([A-Z])([A-Z][a-z])", r"([a-z])([A-Z])", r"([A-Za-z])([0-9])", r"([0-9])([A-Za-z])"):
        t = F.regexp_replace(t, pattern, "$1 $2")
    return F.filter(F.split(t, " +"), lambda x: x != "")


def strip_concepts(c) -> Column:
    """Without fenced and inline code, links' targets, URLs, mail addresses and user names."""
    t = F.regexp_replace(_col(c), r"(?s)```.*?```|~~~.*?~~~", " ")
    t = F.regexp_replace(t, r"`[^`]*`", " ")
    t = F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]*\)", "$1")
    t = F.regexp_replace(t, r"https?://\S+|www\.\S+", " ")
    t = F.regexp_replace(t, r"\b[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+\b", " ")
    return F.regexp_replace(t, r"(^|[^A-Za-z0-9_])@[A-Za-z0-9_-]+", "$1 ")


def letter_tokens(c) -> Column:
    return F.regexp_extract_all(F.lower(_col(c)), F.lit("([a-z]+)"), 1)


def prepare_tokens(c, stop_words: list[str] | None = None, vocabulary: list[str] | None = None, limit: int | None = None) -> Column:
    """Letter tokens without stop words, within a vocabulary, up to a limit."""
    t = letter_tokens(strip_concepts(c))
    if stop_words:
        t = F.filter(t, lambda x: ~x.isin(*stop_words))
    if vocabulary is not None:
        t = F.filter(t, lambda x: x.isin(*vocabulary) if vocabulary else F.lit(False))
    return F.slice(t, 1, limit) if limit is not None else t


def letter_stats(c) -> Column:
    """Letters, of them other than a to z, and the ratio of these."""
    letters = F.length(F.regexp_replace(_col(c), r"[^\p{L}]", ""))
    other = letters - F.length(F.regexp_replace(_col(c), r"[^A-Za-z]", ""))
    return F.struct(letters.alias("letters"), other.alias("other"), F.when(letters > 0, other / letters).otherwise(F.lit(0.0)).alias("ratio"))


def split_topics(c) -> Column:
    """Distinct sorted topics of a list parted by commas, semicolons or white space; none, nan and null are left out."""
    t = F.transform(F.split(_col(c), r"[,;\s]+"), F.lower)
    return F.array_sort(F.array_distinct(F.filter(t, lambda x: ~x.isin("", "none", "nan", "null"))))


def topic_slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(_col(c))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def topic_name(c) -> Column:
    return F.lower(F.trim(F.coalesce(_col(c), F.lit(""))))


def plural_variants(c) -> Column:
    """Simple plural and singular forms: y as ies, with an s, without its last s; short words keep theirs."""
    t, n = _col(c), F.length(_col(c))
    ies = F.when(t.endswith("y") & (n > 2), F.regexp_replace(t, "y$", "ies"))
    return F.array_compact(F.array(ies, F.when(~t.endswith("s"), F.concat(t, F.lit("s"))), F.when(t.endswith("s") & (n > 3), F.regexp_replace(t, "s$", ""))))


def text_window(c, limit: int | None) -> Column:
    """The head of a text that is read for so many tokens: WINDOW characters each, LEAST_WINDOW at least."""
    return _col(c) if limit is None or limit <= 0 else F.substring(_col(c), 1, max(LEAST_WINDOW, limit * WINDOW))


def split_known(token: str, words: list[str], allowed: frozenset[str] | None) -> list[str]:
    """A file name's token split at known words (longest first) at its ends, so that all parts are allowed; without a list of
    allowed ones at most twice, into parts of two letters or more."""
    t = (token or "").strip().lower()
    if len(t) < 4:
        return [t] if t else []

    def cuts(x: str):
        for w in words:
            if len(w) > 1 and w != x:
                if x.startswith(w):
                    yield w, x[len(w) :], True
                if x.endswith(w):
                    yield x[: -len(w)], w, False

    known: dict[str, list[str] | None] = {}

    def whole(x: str) -> list[str] | None:
        if x in allowed:
            return [x]
        if x not in known:
            known[x] = None
            for a, b, at_start in cuts(x):
                rest = whole(b if at_start else a) if (a if at_start else b) in allowed else None
                if rest is not None:
                    known[x] = [a, *rest] if at_start else [*rest, b]
                    break
        return known[x]

    def once(x: str) -> list[str]:
        fits = ([a, b] for a, b, _ in cuts(x) if min(len(a), len(b)) > 1 and (allowed is None or {a, b} <= allowed))
        return next(fits, [x])

    if allowed is not None and (found := whole(t)) is not None:
        return found
    first = once(t)
    return first if first == [t] else [y for x in first for y in once(x)]


def split_known_tokens(c, words: list[str], allowed: list[str] | None = None) -> Column:
    """split_known() over a column; the search has a state, so it runs in Arrow batches, each distinct token once."""
    order, ok = sorted(set(words), key=lambda w: (-len(w), w)), None if allowed is None else frozenset(allowed)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        of = {t: split_known(t, order, ok) for t in s.dropna().unique()}
        return s.map(lambda t: of.get(t, []))

    return run(_col(c))


def path_order(path) -> list[Column]:
    """Sort columns: depth, then the path without regard to case, then the path."""
    return [F.size(F.split(_col(path), "/")), F.lower(_col(path)), _col(path)]


def diff_path(c) -> Column:
    """A path of a diff header without a/ or b/; /dev/null is null."""
    return F.when(_col(c) != "/dev/null", F.regexp_replace(_col(c), "^[ab]/", ""))


def relative_path(path, root: str) -> Column:
    t = F.regexp_replace(_col(path), r"\\", "/")
    return F.when(t.startswith(root.rstrip("/") + "/"), F.substring(t, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(F.regexp_replace(t, r"^(\./)+", ""))


def text_or_base64(c) -> Column:
    """A binary as (text, null) where it is UTF-8, else as (null, base64)."""
    t = F.try_validate_utf8(_col(c).cast("string"))
    return F.struct(t.alias("text"), F.when(t.isNull(), F.base64(_col(c))).alias("base64"))


def front_matter(c) -> Column:
    """The key: value lines between --- marks at the text's head."""
    block = F.regexp_extract(_col(c), r"(?s)\A---\s*\n(.*?)\n---", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: x.rlike(r"^[A-Za-z0-9_]+\s*:"))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_extract(x, r"(?s)^[^:]*:(.*)$", 1)))))
