"""Label standardization and levels. The tables are dimensions: DataFrames of (raw, standard) and (standard, level), read
from wherever they are kept, so a new taxonomy needs no code."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import NOUN_ENDINGS, is_named_type, lookup_key, smell_lookup_key
from .facts import dim_join

# Refactoring labels of low and of medium level; every other known label is high.
LOW_LEVEL = [
    "Add Parameter Modifier", "Add Variable Annotation", "Add Variable Modifier", "Assert Throws", "Assert Timeout", "Change Variable Type",
    "Extract Variable", "Inline Variable", "Invert Condition", "Merge Catch", "Merge Conditional", "Merge Variable",
    "Modify Variable Annotation", "Move Code", "Remove Parameter Modifier", "Remove Variable Annotation", "Remove Variable Modifier",
    "Rename Parameter", "Rename Variable", "Replace Anonymous with Lambda", "Replace Attribute", "Replace Conditional With Ternary",
    "Replace Conditional with Assumption", "Replace Generic With Diamond", "Replace Loop with Pipeline", "Replace Pipeline with Loop",
    "Split Conditional", "Split Variable", "Try With Resources",
]
MEDIUM_LEVEL = [
    "Change Attribute Type", "Change Parameter Type", "Change Return Type", "Extract And Move Method", "Extract Attribute", "Extract Class",
    "Extract Fixture", "Extract Method", "Extract Subclass", "Inline Attribute", "Inline Method", "Localize Parameter", "Merge Method",
    "Move And Inline Method", "Parameterize Attribute", "Replace Anonymous with Class", "Replace Attribute with Variable",
    "Replace Variable with Attribute", "Split Class", "Split Method", "Extract", "Extract And Move", "Inline",
]


def level_dim(spark, high: list[str]) -> DataFrame:
    """(key, standard, level) of the fixed low and medium labels and of the given high ones."""
    rows = [(x, level) for level, xs in (("low", LOW_LEVEL), ("medium", MEDIUM_LEVEL), ("high", high)) for x in xs]
    return spark.createDataFrame(rows, "standard string, level string").withColumn("key", lookup_key("standard"))


def standardize(df: DataFrame, label: str, aliases: DataFrame, canonical: DataFrame, smells: bool = False) -> DataFrame:
    """Adds standard: the alias's label, else the canonical label with the same key, else null."""
    key = smell_lookup_key if smells else lookup_key
    a = aliases.select(key("raw").alias("__key"), F.col("standard").alias("__a")).dropDuplicates(["__key"])
    c = canonical.select(key("standard").alias("__key"), F.col("standard").alias("__c")).dropDuplicates(["__key"])
    out = dim_join(dim_join(df.withColumn("__key", key(label)), a, "__key"), c, "__key")
    return out.withColumn("standard", F.coalesce("__a", "__c")).drop("__key", "__a", "__c")


def lemmas(tokens: DataFrame, token: str, vocabulary: DataFrame, exceptions: DataFrame | None = None) -> DataFrame:
    """(token, lemma) of the distinct tokens: an exception's lemma, else the shortest of the token and its forms without a
    plural ending that is in the vocabulary (column lemma), else the token."""
    t = F.col("token")
    forms = F.array(t, *[F.when(t.endswith(a) & (F.length(t) > len(a)), F.concat(F.substring(t, F.lit(1), F.length(t) - len(a)), F.lit(b))) for a, b in NOUN_ENDINGS])
    one = tokens.select(F.col(token).alias("token")).where("token is not null").distinct()
    found = dim_join(one.select("token", F.explode(F.array_compact(forms)).alias("lemma")), vocabulary.select("lemma").distinct(), "lemma", "inner")
    best = found.groupBy("token").agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma")).alias("b")).select("token", F.col("b.lemma").alias("__l"))
    out = one.join(best, "token", "left")
    if exceptions is not None:
        out = dim_join(out, exceptions.select("token", F.col("lemma").alias("__x")).dropDuplicates(["token"]), "token")
    return out.select("token", F.coalesce(*(["__x"] if exceptions is not None else []), "__l", "token").alias("lemma"))


def smell_by_message(message, needles: list[tuple[str, str]]):
    """The smell of the first needle that the message contains; null if none does."""
    out = F.lit(None).cast("string")
    for needle, smell in reversed(needles):
        out = F.when(F.lower(F.col(message)).contains(needle.lower()), smell).otherwise(out)
    return out


def level_counts(df: DataFrame, key: list[str], counts: str, dim: DataFrame, levels: list[str]) -> DataFrame:
    """Sums of a count map per level, 0-filled; unnamed labels are left out."""
    long = df.select(*key, F.explode_outer(counts).alias("label", "n"))
    long = dim_join(long.withColumn("key", lookup_key("label")), dim.select("key", "level"), "key")
    use = is_named_type("label") & (F.col("n") > 0)
    return long.groupBy(*key).agg(*[F.coalesce(F.sum(F.when(use & (F.col("level") == x), F.col("n"))), F.lit(0)).alias(x) for x in levels])


def label_maps(df: DataFrame, key: list[str], raw: str, standard: str, level: str) -> DataFrame:
    """raw -> standard and standard -> level of each key as sorted JSON."""
    pairs = lambda a, b: F.to_json(F.map_from_entries(F.array_sort(F.collect_set(F.struct(a, b)))))
    return df.groupBy(*key).agg(pairs(raw, standard).alias("raw_to_standard"), pairs(standard, level).alias("standard_to_level"))
