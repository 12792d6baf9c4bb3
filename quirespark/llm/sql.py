"""DuckDB SQL for the rows of the registered queries, where SQL can express them."""

from . import license_scan

OP3_EXACT_DEDUP = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       text_sha256
FROM digests
WINDOW same AS (PARTITION BY text_sha256)
"""

OP4_LICENSE_SCAN = license_scan.oracle_sql("""
  SELECT doc_id, text, 'shelf/' || (doc_id // 1000) || CASE
    WHEN doc_id % 1000 = 0 THEN '/LICENSE'
    WHEN doc_id % 20 = 0 THEN '/' || (doc_id // 20) || '/LICENSE'
    ELSE '/' || (doc_id // 20) || '/' || doc_id || '.txt' END AS path
  FROM documents
""")

OP11_SUBSTRING_DEDUP = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), windows AS (
  SELECT doc_id, first, array_to_string(words[first : first + 12], ' ') AS passage
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS first FROM texts)
), repeats AS (
  SELECT doc_id, first FROM windows QUALIFY min(doc_id) OVER (PARTITION BY passage) < doc_id
), removed AS (
  SELECT DISTINCT doc_id, unnest(range(first, first + 13)) AS place FROM repeats
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS kept_text, count(*) AS n_kept
  FROM (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM texts)
  ANTI JOIN removed USING (doc_id, place)
  GROUP BY doc_id
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept_text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""

ORACLES = {"op3_exact_dedup": OP3_EXACT_DEDUP, "op4_license_scan": OP4_LICENSE_SCAN, "op11_substring_dedup": OP11_SUBSTRING_DEDUP}
