"""Whether refactoring operations are still there in a later snapshot, from the contents of its files: all code elements that
are asked of a file are looked for in one pass over its text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import operation_retention

#: Elements that one pass looks for; the text of a file that more are asked of is read once for each part of them.
ELEMENTS = 4096


def found_elements(text: str | None, elements: list[str]) -> list[bool]:
    """Whether each element is a part of the text."""
    import ahocorasick

    if not text:
        return [False] * len(elements)
    if len(elements) < 4:
        return [e in text for e in elements]
    machine = ahocorasick.Automaton()
    for i, e in enumerate(elements):
        machine.add_word(e, i)
    machine.make_automaton()
    seen = {i for _, i in machine.iter(text)}
    return [i in seen for i in range(len(elements))]


def locate(locations: DataFrame, files: DataFrame, snapshot: str, path: str, element: str, text: str, most: int = ELEMENTS) -> DataFrame:
    """(snapshot, path, element, found) of the distinct elements asked of each file that is there. A file that is asked of many
    is not one group: its elements are dealt into parts of about `most`."""
    asked = locations.where(F.col(element).isNotNull() & (F.col(element) != "")).select(snapshot, path, element).distinct()
    sizes = asked.groupBy(snapshot, path).agg(F.ceil(F.count(F.lit(1)) / F.lit(most)).alias("parts"))
    part = F.pmod(F.xxhash64(element), F.col("parts"))
    lists = asked.join(sizes, [snapshot, path]).groupBy(snapshot, path, part.alias("part")).agg(F.collect_list(element).alias("elements"))
    held = lists.join(files.select(snapshot, path, text), [snapshot, path])

    @F.pandas_udf("array<boolean>")
    def search(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([found_elements(t, list(e)) for t, e in zip(texts, wanted)])

    pairs = F.arrays_zip(F.col("elements").alias("element"), search(text, "elements").alias("found"))
    return held.select(snapshot, path, F.explode(pairs).alias("p")).select(snapshot, path, F.col("p.element").alias(element), "p.found")


def retained_operations(
    locations: DataFrame, files: DataFrame, snapshots: DataFrame, renames: DataFrame, operation: list[str], snapshot: str = "snapshot", path: str = "path", element: str = "element", text: str = "text"
) -> DataFrame:
    """Per operation and snapshot: checked locations, file_matches, exact_matches and the status. A path is followed through
    renames (snapshot, path, renamed). An operation is unknown if its snapshot is not there or it has no location with a path;
    files and renames have one row a (snapshot, path)."""
    trimmed = F.regexp_replace(F.coalesce(element, F.lit("")), r"^\s+|\s+$", "")
    moved = locations.withColumn(element, trimmed).join(renames.select(snapshot, path, "renamed"), [snapshot, path], "left")
    moved = moved.withColumn(path, F.coalesce("renamed", path)).drop("renamed")
    found = locate(moved, files, snapshot, path, element, text)
    there = files.select(snapshot, path, F.lit(True).alias("file"))
    seen = moved.join(there, [snapshot, path], "left").join(found, [snapshot, path, element], "left")
    seen = seen.join(snapshots.select(snapshot, F.lit(True).alias("known")), snapshot, "left")
    ok = F.col("known") & F.col(path).isNotNull()
    out = seen.groupBy(*operation, snapshot).agg(
        F.count_if(ok).alias("checked"), F.count_if(ok & F.col("file")).alias("file_matches"), F.count_if(ok & F.col("found")).alias("exact_matches")
    )
    return out.withColumn("status", operation_retention(F.col("file_matches") > 0, F.col("exact_matches") > 0, "checked"))
