"""TF-IDF, one-vs-rest classification and ranking metrics."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, Normalizer, RegexTokenizer, SQLTransformer, StopWordsRemover
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tfidf_pipeline(text: str, features: int = 20_000, min_df: int = 2) -> Pipeline:
    """Words and word pairs without English stop words, the most frequent `features`, idf-weighted, of length 1."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="words_", pattern=r"(?u)\b\w\w+\b", gaps=False),
        StopWordsRemover(inputCol="words_", outputCol="kept_"),
        NGram(n=2, inputCol="kept_", outputCol="pairs_"),
        SQLTransformer(statement="SELECT *, concat(kept_, pairs_) AS terms_ FROM __THIS__"),
        CountVectorizer(inputCol="terms_", outputCol="counts_", vocabSize=features, minDF=min_df),
        IDF(inputCol="counts_", outputCol="weights_"),
        Normalizer(inputCol="weights_", outputCol="features", p=2.0),
    ])


def term_weights(df: DataFrame, key: str, tokens) -> DataFrame:
    """(key, term, tf, weight): (1 + ln tf)(ln((1 + n)/(1 + df)) + 1), divided by the document's length; exact, in SQL."""
    tf = df.select(key, F.explode(tokens).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = df.count()
    per = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    w = (F.lit(1.0) + F.ln(F.col("tf").cast("double"))) * (F.ln(F.lit(1.0 + n) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
    raw = tf.join(per, "term").withColumn("w", w)
    norm = raw.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, key).select(key, "term", "tf", (F.col("w") / F.col("norm")).alias("weight"))


def fit_one_vs_rest(df: DataFrame, features: str, labels: str, names: list[str], iterations: int = 50) -> dict:
    """A balanced logistic regression per label (labels is an array of names)."""
    models, n = {}, df.count()
    for name in names:
        hit = F.array_contains(labels, name).cast("double")
        pos = df.where(F.array_contains(labels, name)).count()
        if 0 < pos < n:
            weighted = df.withColumn("label", hit).withColumn("weight", F.when(hit == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))))
            models[name] = LogisticRegression(featuresCol=features, weightCol="weight", maxIter=iterations).fit(weighted)
    return models


def scores(df: DataFrame, models: dict, features: str, key: str) -> DataFrame:
    """(key, topic, score) for every label."""
    from pyspark.ml.functions import vector_to_array

    out = df.select(key, features)
    for i, m in enumerate(models.values()):
        held = [c for c in out.columns]
        out = m.transform(out.withColumnRenamed(features, m.getFeaturesCol()) if features != m.getFeaturesCol() else out)
        out = out.select(*held, vector_to_array("probability")[1].alias(f"s{i}"))
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("topic"), F.col(f"s{i}").alias("score")) for i, k in enumerate(models)]))
    return out.select(key, pairs.alias("p")).select(key, "p.topic", "p.score")


def predict(scored: DataFrame, key: str, threshold: float | None = None, k: int | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Topics by score: those above (not at) the threshold, or the k best; ranked anew after the exclusion."""
    rows = scored.where(~F.col("topic").isin(*exclude)) if exclude else scored
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "topic")))
    return rows.where((F.col("score") > threshold) if threshold is not None else (F.col("rank") <= (k or 5)))


def at_k(scored: DataFrame, truth: DataFrame, key: str, ks: list[int]) -> DataFrame:
    """Per k: mean precision, recall (over the lesser of k and the labels' number), F1 and the share with a hit (S@k)."""
    ranked = scored.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), "topic")))
    hit = ranked.join(truth.select(key, "topic", F.lit(1).alias("hit")), [key, "topic"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    labels = truth.groupBy(key).agg(F.count(F.lit(1)).alias("labels"))
    per = hit.groupBy(key).agg(*[F.sum(F.when(F.col("rank") <= k, F.col("hit")).otherwise(0)).alias(f"h{k}") for k in ks]).join(labels, key)
    long = per.select(key, "labels", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks])).alias("x")).select(key, "labels", "x.*")
    p, r = F.col("h") / F.col("k"), F.col("h") / F.least("k", "labels")
    return long.groupBy("k").agg(F.avg(p).alias("precision"), F.avg(r).alias("recall"), F.avg(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))).alias("f1"), F.avg((F.col("h") > 0).cast("double")).alias("success"))


def lrap(scored: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """Label ranking average precision: over true labels, the share of true ones at or above their score."""
    t = scored.join(truth.select(key, "topic", F.lit(1).alias("hit")), [key, "topic"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    w = W.partitionBy(key).orderBy(F.desc("score")).rangeBetween(W.unboundedPreceding, 0)
    r = t.withColumn("above", F.count(F.lit(1)).over(w)).withColumn("good", F.sum("hit").over(w)).where("hit = 1")
    return r.groupBy(key).agg(F.avg(F.col("good") / F.col("above")).alias("v")).agg(F.avg("v").alias("lrap"))


def threshold_metrics(scored: DataFrame, truth: DataFrame, key: str, threshold: float) -> DataFrame:
    """All metrics of the decisions score > threshold, in one row. scored has every label of every key.

    precision, recall, f1 are over all decisions; _macro, _weighted and _samples are means over labels, labels by their true
    number, and keys; 0 where there is nothing to divide by. Ranking metrics rank by the decision, so a tie counts as an error.
    auc_* are null if a label has one class only."""
    t = scored.join(truth.select(key, "topic", F.lit(1).alias("y")), [key, "topic"], "left").select(F.col(key).cast("string").alias("k"), "topic", (F.col("score") > threshold).cast("int").alias("p"), F.coalesce("y", F.lit(0)).alias("y"))
    # by key and by label in one pass
    g = t.groupingSets([[F.col("k")], [F.col("topic")]], F.col("k"), F.col("topic")).agg(F.sum(F.col("p") * F.col("y")).alias("tp"), F.sum("p").alias("pp"), F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"), F.grouping("k").alias("is_label"))
    tp, pp, pos, n = (F.col(c).cast("double") for c in ("tp", "pp", "pos", "n"))
    fp, fn = pp - tp, pos - tp
    div = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    both = F.col("is_label") == 1
    key_mean = lambda c: F.avg(F.when(~both, c))
    label_mean = lambda c: F.avg(F.when(both, c))
    total = lambda c: F.sum(F.when(both, c))
    each = {"precision": div(tp, pp), "recall": div(tp, pos), "f1": div(2 * tp, pp + pos)}
    auc = F.when((pos > 0) & (pos < n), (1 + tp / pos - fp / (n - pos)) / 2)
    ap = F.when(pos > 0, div(tp, pos) * div(tp, pp) + (1 - div(tp, pos)) * pos / n).otherwise(F.lit(0.0))
    s_tp, s_pp, s_pos, s_n = total(tp), total(pp), total(pos), total(n)
    micro_auc = F.when((s_pos > 0) & (s_pos < s_n), (1 + s_tp / s_pos - (s_pp - s_tp) / (s_n - s_pos)) / 2)
    whole = F.count(F.when(both & auc.isNull(), 1)) == 0
    wrong_pairs = F.when((pos > 0) & (pos < n), (fn * (n - pos) + tp * fp) / (pos * (n - pos))).otherwise(F.lit(0.0))
    reach = F.when(pos == 0, F.lit(0.0)).when(fn > 0, n).otherwise(pp)
    return g.agg(
        div(s_tp, s_pp).alias("precision"), div(s_tp, s_pos).alias("recall"), div(2 * s_tp, s_pp + s_pos).alias("f1"),
        key_mean((fp + fn == 0).cast("double")).alias("subset_accuracy"), (total(fp + fn) / s_n).alias("hamming_loss"), key_mean(pp).alias("mean_labels"),
        key_mean((tp > 0).cast("double")).alias("success_rate"), label_mean((pp > 0).cast("double")).alias("coverage"), key_mean(wrong_pairs).alias("ranking_loss"), key_mean(reach).alias("coverage_error"),
        *[label_mean(c).alias(f"{k}_macro") for k, c in each.items()], *[div(total(c * pos), s_pos).alias(f"{k}_weighted") for k, c in each.items()], *[key_mean(c).alias(f"{k}_samples") for k, c in each.items()],
        micro_auc.alias("auc_micro"), F.when(whole, label_mean(auc)).alias("auc_macro"), F.when(whole, total(auc * pos) / s_pos).alias("auc_weighted"),
        (div(s_tp, s_pos) * div(s_tp, s_pp) + (1 - div(s_tp, s_pos)) * s_pos / s_n).alias("average_precision_micro"), label_mean(ap).alias("average_precision_macro"),
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)
