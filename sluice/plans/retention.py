"""Operations on the documents as files of snapshots: each document's operation names a piece of its own text, there and in
the next document. French ones were renamed; those without a source have no file any more."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retention as R
from ..sources.tables import read_table


def content_retention(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source", F.coalesce("lang", F.lit("none")).alias("snapshot"))
    piece = F.substring(F.col("text"), 11, 12)
    locations = docs.select("doc_id", "snapshot", piece.alias("element"), F.explode(F.array(F.col("doc_id").cast("string"), (F.col("doc_id") + 1).cast("string"))).alias("path"))
    renamed = docs.where("lang = 'fr'").select("snapshot", F.col("doc_id").cast("string").alias("path"), F.concat(F.lit("new/"), F.col("doc_id").cast("string")).alias("renamed"))
    place = F.concat(F.when(F.col("lang") == "fr", "new/").otherwise(""), F.col("doc_id").cast("string"))
    files = docs.where("source IS NOT NULL").select("snapshot", place.alias("path"), "text")
    snapshots = docs.where("lang IS NOT NULL").select("snapshot").distinct()
    return R.retained_operations(locations, files, snapshots, renamed, ["doc_id"])


QUERIES = {
    "content_retention": (content_retention, r"""WITH d AS (SELECT doc_id, text, lang, source, coalesce(lang, 'none') AS snapshot FROM documents),
      l AS (SELECT doc_id, snapshot, regexp_replace(coalesce(substring(text, 11, 12), ''), '^\s+|\s+$', '', 'g') AS element, unnest([doc_id, doc_id + 1]) AS path FROM d),
      m AS (SELECT l.doc_id, l.snapshot, element, f.doc_id IS NOT NULL AS file, f.doc_id IS NOT NULL AND element <> '' AND contains(coalesce(f.text, ''), element) AS found
        FROM l LEFT JOIN d f ON f.doc_id = l.path AND f.snapshot = l.snapshot AND f.source IS NOT NULL),
      g AS (SELECT doc_id, snapshot, snapshot <> 'none' AS known, count(*) AS n, count(*) FILTER (file) AS f, count(*) FILTER (found) AS e FROM m GROUP BY ALL)
      SELECT doc_id, snapshot, CASE WHEN known THEN n ELSE 0 END AS checked, CASE WHEN known THEN f ELSE 0 END AS file_matches, CASE WHEN known THEN e ELSE 0 END AS exact_matches,
        CASE WHEN NOT known THEN 'unknown' WHEN f > 0 AND e > 0 THEN 'retained' WHEN f > 0 THEN 'weakly_retained' ELSE 'not_retained' END AS status FROM g"""),
}
