"""Topic rules from a catalog of topics with aliases, merged with rules that were there before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import _col
from ..functions.text import plural_variants
from .facts import dim_join

# The rule tables.
TABLES = ["abbr", "abstract", "contains_selected_topics", "contains_top_topics", "contractions", "delete", "integer_topics", "remove_lemmatize_topic", "remove_plural_topics", "remove_stemmed_topic", "replace", "replace_alias", "split_dash_topics", "topics_contains_number", "topics_contains_version"]
# Outputs that delete and that keep a topic.
DELETE, KEEP = "-1", "-2"
# A term with a version.
VERSION = r"(?:^|[-_])v?\d+(?:[-_.]\d+)*$|v\d+"

_BY_OUTPUT = ["replace", "replace_alias"]
_TEXTS = "array<string>"


def unquoted(c) -> Column:
    """Trimmed, and without a pair of quotes around it."""
    t = F.trim(_col(c))
    return F.when(t.rlike(r"(?s)^(['\"]).*\1$") & (F.length(t) > 1), F.trim(F.substring(t, F.lit(2), F.length(t) - 2))).otherwise(t)


def catalog_slug(c) -> Column:
    """Lower case, + as plus and # as sharp, all else but letters and digits as single dashes."""
    t = F.replace(F.replace(F.lower(unquoted(c)), F.lit("+"), F.lit("plus")), F.lit("#"), F.lit("sharp"))
    return F.regexp_replace(F.regexp_replace(t, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def compact(c) -> Column:
    return F.regexp_replace(F.lower(_col(c)), "[^a-z0-9]+", "")


def parts(c) -> Column:
    return F.filter(F.split(catalog_slug(c), "-"), lambda x: x != "")


def catalog_terms(entries: DataFrame) -> DataFrame:
    """(term, canonical, kind, source) of each entry (topic, aliases, source): the topic, its aliases, and both without dashes."""
    term = lambda t, kind: F.struct(t.alias("term"), F.lit(kind).alias("kind"))
    topic = F.col("topic")
    own = F.array(term(topic, "topic"), term(compact(topic), "topic_compact_variant"))
    other = F.flatten(F.transform("aliases", lambda a: F.array(term(catalog_slug(a), "alias"), term(compact(catalog_slug(a)), "alias_compact_variant"))))
    all_terms = F.concat(own, F.coalesce(other, F.array().cast("array<struct<term:string,kind:string>>")))
    rows = entries.select("topic", "source", F.explode(all_terms).alias("t")).select(catalog_slug("t.term").alias("term"), F.col("topic").alias("canonical"), "t.kind", "source")
    # a compact form that equals its word is no variant
    return rows.where("term <> ''").groupBy("term", "canonical", "source").agg(F.collect_set("kind").alias("kinds")).select("term", "canonical", F.when(F.array_contains("kinds", "topic"), "topic").when(F.array_contains("kinds", "alias"), "alias").otherwise(F.array_min("kinds")).alias("kind"), "source")


def alias_choices(terms: DataFrame) -> DataFrame:
    """One canonical topic per term: the topic of that name, else the least topic, else the least canonical; candidates and
    whether there were several."""
    rank = F.when((F.col("canonical") == F.col("term")) & (F.col("kind") == "topic"), 0).when(F.col("kind") == "topic", 1).otherwise(2)
    out = terms.groupBy("term").agg(F.min(F.struct(rank.alias("rank"), "canonical")).alias("best"), F.array_sort(F.collect_set("canonical")).alias("candidates"))
    return out.select("term", F.col("best.canonical").alias("canonical"), "candidates", (F.size("candidates") > 1).alias("conflict"))


def rule_rows(entries: DataFrame, choices: DataFrame) -> DataFrame:
    """(rule_file, body) of all rule tables, distinct; a body has two texts at least."""
    t, c = F.col("term"), F.col("canonical")
    other, digits, dash = t != c, t.rlike("[0-9]"), t.contains("-")
    body = lambda *x: F.array(*x).cast(_TEXTS)
    target = F.when(other, c).otherwise(KEEP)
    plain = [("replace", other, body(c, t)), ("replace_alias", other, body(c, t)), ("contractions", other & (F.length(t) <= 6) & ~dash, body(t, c)), ("abstract", other & (F.length(t) <= 8), F.concat(body(t), parts(c))),
             ("split_dash_topics", dash, body(t, target)), ("contains_top_topics", ~dash & other, body(t, c)), ("contains_selected_topics", ~dash & other, body(t, c)), ("topics_contains_number", digits, body(t, target)),
             ("topics_contains_version", digits & t.rlike(VERSION), body(t, target)), ("integer_topics", t.rlike("^[0-9][a-z0-9-]*$"), body(t, target)), ("delete", F.col("conflict"), body(t, F.lit(DELETE)))]
    rule = lambda name, when, row: F.when(when, F.struct(F.lit(name).alias("rule_file"), row.alias("body")))
    out = choices.select(F.explode(F.array_compact(F.array(*[rule(*x) for x in plain]))).alias("r")).select("r.*")
    forms = choices.select(F.explode(plural_variants("term")).alias("form"), "canonical").where("form <> canonical")
    for name in ("remove_plural_topics", "remove_lemmatize_topic", "remove_stemmed_topic"):
        out = out.unionByName(forms.select(F.lit(name).alias("rule_file"), body(F.col("form"), F.col("canonical")).alias("body")))
    long = lambda x: F.filter(parts(x), lambda p: F.length(p) >= 2)
    split = entries.select("topic", F.explode(F.concat(F.array(long("topic")), F.transform(F.coalesce("aliases", F.array().cast(_TEXTS)), long))).alias("p")).where(F.size("p") >= 2)
    out = out.unionByName(split.select(F.lit("abbr").alias("rule_file"), F.concat(F.array("topic"), "p").alias("body")))
    return out.where(F.size("body") >= 2).distinct()


def indexed(rules: DataFrame) -> DataFrame:
    """With the row's number in its table, from 1, in order of the bodies."""
    return rules.withColumn("index", F.row_number().over(W.partitionBy("rule_file").orderBy("body")))


def normalize_rules(rows: DataFrame, choices: DataFrame, topics: DataFrame) -> DataFrame:
    """Former rules (rule_file, row; its first text is a number) in the catalog's words: adds body, action and reason. body is
    null where the row is malformed, or an output is neither a topic, nor an alias of one, nor a directive."""
    clean = F.filter(F.transform(F.slice("row", 2, 1 << 20), lambda x: F.trim(x)), lambda x: x != "")
    r = rows.withColumn("__b", clean)
    key = ["rule_file", "row"]
    first_out = F.col("rule_file").isin(*_BY_OUTPUT, "abbr")
    outs = F.when(first_out, F.slice("__b", 1, 1)).otherwise(F.slice("__b", 2, 1 << 20))
    word = F.lower(unquoted("o"))
    long = r.distinct().select(*key, F.posexplode(outs).alias("pos", "o")).select(*key, "pos", word.alias("w0"), catalog_slug("o").alias("w1"), compact(catalog_slug("o")).alias("w2"))
    names, alias = topics.select(F.col("topic").alias("k"), F.col("topic").alias("v")), choices.select(F.col("term").alias("k"), F.col("canonical").alias("v"))
    found = []
    for i, (dim, by) in enumerate([(names, "w0"), (names, "w1"), (alias, "w0"), (alias, "w1"), (alias, "w2")]):
        long = dim_join(long, dim.withColumnRenamed("k", by).withColumnRenamed("v", f"f{i}"), by)
        found.append(f"f{i}")
    hit = F.coalesce(F.when(F.col("w0").isin(DELETE, KEEP), F.col("w0")), *found)
    got = long.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", hit.alias("h")))), lambda x: x["h"]).alias("__o"))
    j = r.join(got, key, "left")
    head = F.try_element_at("__o", F.lit(1))
    sources = F.filter(F.transform(F.when(first_out, F.slice("__b", 2, 1 << 20)).otherwise(F.slice("__b", 1, 1)), lambda x: F.lower(unquoted(x))), lambda x: x != "")
    lost = F.exists("__o", lambda x: x.isNull()) | (first_out & head.isin(DELETE, KEEP))
    action = F.when((F.size("row") < 3) | (F.size("__b") < 2), "dropped_malformed").when(lost, "dropped_non_catalog_output").when(F.size(sources) == 0, "dropped_malformed").otherwise("candidate")
    reason = F.when(F.size("row") < 3, "row_has_fewer_than_three_columns").when(F.size("__b") < 2, "row_has_no_active_mapping").when(lost, "output_not_in_catalog").when(F.size(sources) == 0, "row_has_no_source_terms").otherwise("outputs_mapped_to_catalog")
    body = F.when(first_out, F.concat(F.array(head), sources)).otherwise(F.concat(sources, "__o"))
    return j.select("rule_file", "row", F.when(action == "candidate", body).alias("body"), action.alias("action"), reason.alias("reason"))


def merge_rules(generated: DataFrame, former: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active rules, audit) of generated rules (rule_file, body) and former ones (normalize_rules()). Of rules that conflict, a
    rule that keeps its topic wins, then a generated one, then the least; equal bodies are one rule."""
    sides = generated.select("rule_file", "body", F.lit(0).alias("side")).unionByName(former.where("body is not null").select("rule_file", "body", F.lit(1).alias("side")))
    one = sides.groupBy("rule_file", "body").agg(F.min("side").alias("side"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("side") == 1).alias("former"))
    b1, b2 = F.col("body")[0], F.try_element_at("body", F.lit(2))
    by_output = F.col("rule_file").isin(*_BY_OUTPUT)
    key = F.when(by_output, F.array(b2)).when(F.col("rule_file") == "abbr", F.slice("body", 2, 1 << 20)).otherwise(F.array(b1))
    keeps = (F.col("rule_file") != "abbr") & (b1 == b2)
    ranked = one.withColumn("__key", key).withColumn("__rank", F.struct((~keeps).alias("k"), "side", F.array_join("body", "\x1f").alias("t")))
    w = W.partitionBy("rule_file", "__key")
    ranked = ranked.withColumn("rivals", F.count(F.lit(1)).over(w)).withColumn("wins", F.col("__rank") == F.min("__rank").over(w))
    audit = former.where("body is null").select("rule_file", "row", F.col("row").alias("body"), "action", "reason").drop("row")
    said = F.when(~F.col("wins"), "conflict_lost").when(F.col("side") == 0, "deduped").otherwise("included")
    why = F.when(~F.col("wins"), "preferred_mapping_won").when(F.col("side") == 0, "exact_duplicate_row").when(F.col("rivals") > 1, "conflict_winner").otherwise("no_conflict")
    audit = audit.unionByName(ranked.where("former > 0 or not wins").select("rule_file", "body", said.alias("action"), why.alias("reason")))
    return ranked.where("wins").select("rule_file", "body"), audit


def merge_counts(generated: DataFrame, former: DataFrame, active: DataFrame) -> DataFrame:
    """Per rule table its generated, former, dropped, repeated, conflicting and active rows."""
    n = F.count(F.lit(1))
    sides = generated.select("rule_file", "body").unionByName(former.where("body is not null").select("rule_file", "body"))
    repeats = sides.groupBy("rule_file").agg((n - F.count_distinct("body")).alias("deduped"), F.count_distinct("body").alias("__d"))
    out = repeats.join(generated.groupBy("rule_file").agg(n.alias("generated")), "rule_file", "full").join(former.groupBy("rule_file").agg(n.alias("former"), F.count_if(F.col("action") == "dropped_non_catalog_output").alias("dropped"), F.count_if(F.col("action") == "dropped_malformed").alias("malformed")), "rule_file", "full")
    out = out.join(active.groupBy("rule_file").agg(n.alias("active")), "rule_file", "left").na.fill(0)
    return out.select("rule_file", "former", "generated", "active", "deduped", (F.col("__d") - F.col("active")).alias("conflicts"), "dropped", "malformed")
