"""Training tables for topic models: eligibility, preparation, sampling, split and outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import records as N
from ..functions import scalars as S
from ..functions import times as D
from ..functions import text as T
from ..sources import writers
from ..sources.tables import shared_folder
from . import relational as R
from . import sampling as B
from .entities import reject_reason


def prepared_records(df: DataFrame, mapped, universe: list[str], text, excluded: list[str] | None = None) -> DataFrame:
    """Adds final_topics (mapped topics within the universe, sorted), prepared_text and reason, the first of skipped_repository,
    no_final_label and empty_prepared_text that holds. df has repository_key."""
    topics = F.array_sort(F.array_distinct(F.array_intersect(S._col(mapped), F.array(*map(F.lit, universe)).cast("array<string>"))))
    out = df.withColumn("final_topics", topics).withColumn("prepared_text", S._col(text))
    skip = N.is_excluded_repository(excluded or [], "repository_key") if excluded else F.lit(False)
    return out.withColumn("reason", reject_reason([("skipped_repository", skip), ("no_final_label", F.size("final_topics") == 0), ("empty_prepared_text", F.trim(F.coalesce("prepared_text", F.lit(""))) == "")]))


def create_training_data(df: DataFrame, mapped, text, token_limit: int, min_topic: int, min_token: int, excluded: list[str] | None = None) -> dict[str, DataFrame]:
    """records, rejects, topics and tokens: topics of min_topic repositories or more are labels; tokens that occur min_token
    times or more are the vocabulary, and a text is its first token_limit tokens of it. text is an array of tokens."""
    base = df.withColumn("__t", S._col(text)).withColumn("__m", F.array_distinct(S._col(mapped)))
    topics = base.select(F.explode("__m").alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_topic)
    tokens = base.select(F.explode("__t").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_token)
    universe = sorted(r.topic for r in topics.select("topic").collect())  # the labels; their number is that of a model's outputs
    # written once, so that both uses of the rows see the same numbers
    path = shared_folder(df.sparkSession, "training-rows")
    base.withColumn("__id", F.monotonically_increasing_id()).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    kept = rows.select("__id", F.posexplode("__t").alias("pos", "token")).join(tokens.select("token"), "token", "left_semi")
    first = kept.groupBy("__id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), 1, token_limit).alias("__k"))
    rows = rows.join(first, "__id", "left").withColumn("__text", F.array_join(F.coalesce("__k", F.array().cast("array<string>")), " "))
    done, rejects = writers.split_rejects(prepared_records(rows, "__m", universe, "__text", excluded).drop("__id", "__t", "__k", "__text", "__m"))
    return {"records": done.withColumn("labels", S.multi_hot(universe, "final_topics")), "rejects": rejects, "topics": topics, "tokens": tokens}


def eligible_records(df: DataFrame, metadata: DataFrame, on: str = "identity_key") -> DataFrame:
    """Adds stars, created_at, stratum and reason (null if eligible). df has identity_key, prepared_text and labels (bits);
    metadata has identity_key, stars and created_at, one row each."""
    j = df.join(metadata.select(on, F.lit(True).alias("__hit"), "stars", "created_at"), on, "left")
    when = S.parse_timestamp("created_at")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    bin_ = F.when(F.coalesce(S.coerce_int("stars"), F.lit(0)) <= 0, "0").when(S.coerce_int("stars") <= 18, "1-18").otherwise("19+")
    reason = reject_reason([("missing_identity", blank(on)), ("empty_prepared_text", blank("prepared_text")), ("invalid_label_vector", F.col("labels").isNull()), ("empty_label_vector_after_topic_filter", ~F.exists("labels", lambda x: x != 0)), ("missing_metadata", F.col("__hit").isNull()), ("invalid_repository_created_at", when.isNull())])
    return j.withColumns({"stratum": F.concat(bin_, F.lit("|"), D.quarter(when)), "reason": reason}).drop("__hit")


def eligibility_counts(df: DataFrame) -> DataFrame:
    """(kind, label, n): rows by reject reason, and eligible ones by stratum, in one aggregation."""
    ok = F.col("reason").isNull()
    return df.groupBy(F.when(ok, "stratum").otherwise("excluded").alias("kind"), F.when(ok, F.col("stratum")).otherwise(F.col("reason")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def sample_training_data(df: DataFrame, metadata: DataFrame, target: int, train_fraction: float, seed: int = 42, on: str = "identity_key") -> DataFrame:
    """A sample of target eligible records, proportional to the strata, with split train or test. Raises if there are fewer."""
    ok = R.first_rows(eligible_records(df, metadata, on).where("reason is null"), [on], ["prepared_text"], keep_null_keys=False)
    sizes = ok.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    have = sizes.agg(F.sum("n")).first()[0] or 0
    if have < target:
        raise ValueError(f"{have} records are eligible, {target} are wanted")
    picked = B.sample_by_quota(ok, ["stratum"], B.proportional_quotas(sizes, "stratum", "n", target), on, seed)
    n, rank = F.count(F.lit(1)).over(W.partitionBy("stratum")), F.row_number().over(W.partitionBy("stratum").orderBy(B.priority(seed, on), on))
    k = F.when(n < 2, n).otherwise(F.greatest(F.lit(1), F.least(n - 1, F.floor(n * F.lit(train_fraction)))))
    return picked.withColumn("split", F.when(rank <= k, "train").otherwise("test")).drop("rank", "reason")


def write_training_data(sample: DataFrame, path: str, labels: list[str], by: str = "split") -> None:
    """train and test as CSV (a column per label, the label vector and the text), and the metadata of all rows."""
    bits = [F.col("labels")[i].alias(x) for i, x in enumerate(labels)]
    rows = sample.select(by, *bits, F.concat(F.lit("["), F.array_join(F.col("labels").cast("array<string>"), " "), F.lit("]")).alias("labels_vector"), F.col("prepared_text").alias("text"))
    for part in ("train", "test"):
        rows.where(F.col(by) == part).drop(by).write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{path}/{part}")
    sample.drop("labels", "prepared_text").write.mode("overwrite").json(f"{path}/metadata")


def collect_repositories(found: DataFrame, key: str, target: int, known: DataFrame | None = None) -> DataFrame:
    """Repositories from search results (key, bucket, query, page, metadata), one row each with all distinct searches that
    found it, up to target in order of their first find; those known from an earlier run count and stay."""
    search = F.struct("bucket", "query", "page")
    rows = found.groupBy(key).agg(F.min(search).alias("first"), F.array_sort(F.collect_set(search)).alias("searches"), F.min_by("metadata", search).alias("metadata"))
    if known is None:
        return rows.orderBy("first", key).limit(target).drop("first")
    fresh = rows.join(known.select(key), key, "left_anti").orderBy("first", key).limit(max(0, target - known.count())).drop("first")
    return known.unionByName(fresh, allowMissingColumns=True)


def sample_pull_requests(df: DataFrame, target: int, languages: list[str], buckets: int = 3, seed: int = 42, id_col: str = "url") -> tuple[DataFrame, DataFrame]:
    """(sample with language, time_bucket and popularity_bucket, balance by dimension). df has language, primary_language,
    languages, created_at and stars. Popularity buckets are quantiles that do not split equal star counts."""
    stars = N.popularity_value("stars")
    cuts = sorted(r.cut for r in B.cut_points(df.select(stars.alias("stars")), "stars", buckets).collect())
    rows = df.withColumns({"language_bucket": F.coalesce(N.target_language("language", "primary_language", "languages", languages), F.lit("unknown")), "time_bucket": D.time_bucket(S.parse_timestamp("created_at"), "day"), "popularity_bucket": B.assign_bucket(stars, cuts)})
    dims = ["language_bucket", "time_bucket", "popularity_bucket"]
    sample = B.stratified_sample(rows, dims, target, id_col, seed)
    from .aggregate import balance

    parts = [balance(sample, d).select(F.lit(d).alias("dimension"), "*") for d in dims]
    return sample, parts[0].unionByName(parts[1]).unionByName(parts[2])


# Tokens of each source that a repository's text takes at most, in order.
SOURCE_TOKENS = {"name": 10, "description": 50, "readme": 400, "wiki": 100, "files": 100}


def repository_features(df: DataFrame, key: list[str], stop_words: list[str] | None = None, vocabulary: list[str] | None = None) -> DataFrame:
    """The text a model sees of a repository (owner, name, description, readme, wiki, files: an array of paths): tokens of each
    source up to its number, files from the root down with each token once a path; with the tokens' counts by source, whether
    there is a description, readme and wiki, and the observed topics (column topics) sorted."""
    take = lambda c, n, window=True: T.prepare_tokens(T.text_window(F.coalesce(c, F.lit("")), n if window else None), stop_words, vocabulary, n)
    paths = N.sort_paths(F.coalesce("files", F.array().cast("array<string>")))
    words = F.transform(paths, lambda p: F.array_distinct(T.letter_tokens(F.array_join(T.split_identifier(p), " "))))
    ok = lambda t: (~t.isin(*stop_words) if stop_words else F.lit(True)) & (t.isin(*vocabulary) if vocabulary else F.lit(True))
    tokens = {
        "name": F.slice(T.letter_tokens(F.concat_ws(" ", F.array_join(T.split_identifier(F.coalesce("owner", F.lit(""))), " "), F.array_join(T.split_identifier(F.coalesce("name", F.lit(""))), " "))), 1, SOURCE_TOKENS["name"]),
        **{c: take(F.col(c), SOURCE_TOKENS[c]) for c in ("description", "readme", "wiki")}, "files": F.slice(F.filter(F.flatten(words), ok), 1, SOURCE_TOKENS["files"]),
    }
    out = df.select(*key, F.array_sort(F.array_distinct(F.coalesce("topics", F.array().cast("array<string>")))).alias("observed_topics"), *[v.alias(f"__{k}") for k, v in tokens.items()], F.size(F.coalesce("files", F.array().cast("array<string>"))).alias("file_count"))
    counts = F.struct(*[F.size(f"__{k}").alias(k) for k in tokens])
    has = [(F.size(f"__{c}") > 0).alias(f"has_{c}") for c in ("description", "readme", "wiki")]
    return out.select(*key, F.array_join(F.concat(*[f"__{k}" for k in tokens]), " ").alias("inference_text"), counts.alias("token_counts"), *has, "file_count", "observed_topics")
