"""The topic model over the documents: their language stands for the topic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import topics as T
from ..sources.tables import read_table, written

FEATURES = 20_000


def _rows(spark, d):
    docs = read_table(spark, d, "documents")
    vocab = T.vocabulary(docs, "text", FEATURES)
    return T.tfidf_rows(docs, ["doc_id", "lang"], "text", vocab, docs.count()), vocab


def tfidf_top_terms(spark, d):
    """The five terms of most weight of each document."""
    rows, vocab = _rows(spark, d)
    return T.top_terms(rows, ["doc_id"], vocab, 5)


def topic_scores(spark, d):
    """Scores of all languages for each document, by a model of all labels fitted on the labelled ones until it has converged."""
    rows, vocab = _rows(spark, d)
    rows = written(rows.withColumn("labels", F.when(F.col("lang").isNotNull(), F.array("lang")).otherwise(F.expr("array()").cast("array<string>"))), "tfidf")
    names = sorted(r[0] for r in rows.where("lang IS NOT NULL").select("lang").distinct().collect())
    models = T.fit_groups(rows.where("lang IS NOT NULL"), names, vocab.count())
    scores = [T.label_scores(rows, ["doc_id"], group, model) for group, model in models] or [rows.select("doc_id", F.lit("").alias("topic"), F.lit(0.0).alias("score")).where("false")]
    return reduce(DataFrame.unionAll, scores).withColumn("score", F.round("score", 6))


QUERIES = {
    "tfidf_top_terms": (tfidf_top_terms, f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+')) AS term FROM documents),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE length(term) > 1 GROUP BY ALL), v AS (SELECT term, count(*) AS df FROM tf GROUP BY term HAVING count(*) >= 2 ORDER BY df DESC, term LIMIT {FEATURES}),
      x AS (SELECT doc_id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS x FROM tf JOIN v USING (term)),
      n AS (SELECT *, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 9) AS weight FROM x)
      SELECT doc_id, term, weight FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, term) <= 5"""),
    "topic_scores": (topic_scores, None),
}
