"""Source scans: the documents stand for files of a C-like language, their source for the snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsers as P
from ..sources.tables import read_table


def _files(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "source", "text", F.lit("java").alias("language"))


def source_scan(spark, d):
    """Lines of code, of comments alone and blank ones of each file."""
    return P.source_lines(_files(spark, d), ["doc_id"], "text", "language")


def code_duplication(spark, d):
    """Repeated lines of code over all files of a snapshot."""
    return P.code_duplication(_files(spark, d), "source", "text", "language")


#: Tokens of the text: a comment leaves a mark on each line it covers, a literal another; what is left of a line is code.
_LINES = r"""t AS (SELECT doc_id, source, regexp_replace(coalesce(text, ''), '\r\n|[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]', chr(10), 'g') AS text FROM documents),
  k AS (SELECT doc_id, source, text, regexp_extract_all(translate(text, chr(1) || chr(2), 'xx'),
    '/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|"(?:\\[^\n]?|[^"\\\n])*"?|''(?:\\[^\n]?|[^''\\\n])*''?|[^/"'']+|/') AS tokens FROM t),
  m AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines, string_split(array_to_string(list_transform(tokens, lambda x:
    CASE WHEN starts_with(x, '/*') OR starts_with(x, '//') THEN regexp_replace(x, '[^\n]*[^\s][^\n]*', chr(1), 'g')
      WHEN starts_with(x, '"') OR starts_with(x, '''') THEN chr(2) ELSE x END), ''), chr(10)) AS marked, text FROM k),
  l AS (SELECT doc_id, source, unnest(lines) AS line, unnest(CASE WHEN text = '' THEN [''] ELSE marked END) AS marked,
    unnest(range(1, len(lines) + 1)) = len(lines) AS last FROM m),
  c AS (SELECT doc_id, source, line, regexp_matches(marked, '[^\s\x01\x02]') AS code, contains(marked, chr(1)) AS comment,
    NOT contains(marked, chr(2)) AND NOT (last AND line = '') AS plain FROM l)"""

QUERIES = {
    "source_scan": (source_scan, f"""WITH {_LINES} SELECT doc_id, CAST(count(*) FILTER (code) AS INT) AS code, CAST(count(*) FILTER (comment AND NOT code) AS INT) AS comment,
      CAST(count(*) FILTER (plain AND NOT code AND NOT comment) AS INT) AS blank FROM c GROUP BY doc_id"""),
    "code_duplication": (code_duplication, f"""WITH {_LINES}, n AS (SELECT source, trim(regexp_replace(line, '\\s+', ' ', 'g')) AS line, count(*) AS c FROM c WHERE code GROUP BY ALL),
      s AS (SELECT source, CAST(sum(c) AS BIGINT) AS ncloc, CAST(sum(c - 1) AS BIGINT) AS duplicated FROM n GROUP BY source), f AS (SELECT source, count(*) AS files FROM documents GROUP BY source)
      SELECT f.source, files, coalesce(ncloc, 0) AS ncloc, coalesce(duplicated, 0) AS duplicated, coalesce(duplicated * 100.0::DOUBLE / ncloc, 0) AS density
      FROM f LEFT JOIN s ON f.source IS NOT DISTINCT FROM s.source"""),
}
