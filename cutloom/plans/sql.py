"""SQL of the derived tables, for the oracle of each query."""

from __future__ import annotations

WORDS = r"""
tk AS (SELECT conv_id AS asset_id, turn, regexp_extract_all(coalesce(text, ''), '\S+') AS ws FROM conversations),
t1 AS (SELECT asset_id, turn, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM tk),
t2 AS (SELECT *, length(word) AS n, row_number() OVER (PARTITION BY asset_id ORDER BY turn, pos) - 1 AS word_idx FROM t1),
t3 AS (SELECT *, 60000 + 40000 * n AS dur,
  CASE WHEN regexp_matches(word, '[.!?]$') THEN 600000 + (n * 137 + word_idx * 31) % 700 * 1000
       WHEN regexp_matches(word, ',$') THEN 280000 + (n * 53 + word_idx * 17) % 250 * 1000
       ELSE (n * 29 + word_idx * 7) % 120 * 1000 END + CASE WHEN pos = 1 AND turn > 0 THEN 1500000 ELSE 0 END AS lead_us FROM t2),
t4 AS (SELECT *, CAST(sum(dur + lead_us) OVER (PARTITION BY asset_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS end_us FROM t3),
words AS (SELECT asset_id, CAST(word_idx AS INTEGER) AS word_idx, turn, word, end_us - dur AS start_us, end_us,
  CAST((unicode(word) * 31 + n * 17 + word_idx * 7) % 1000 AS BIGINT) AS conf_milli FROM t4),
drops AS (SELECT asset_id, greatest(start_us - 200000, 0) AS start_us, end_us + 400000 AS end_us,
  CASE WHEN word_idx % 2 = 0 THEN 'reviewer' ELSE 'rule' END AS reason FROM words WHERE conf_milli < 20)
"""

KEPT = (
    WORDS
    + """,
kept AS (SELECT * FROM words w WHERE NOT EXISTS (SELECT 1 FROM drops d WHERE d.asset_id = w.asset_id
  AND (w.start_us + w.end_us) >= 2 * d.start_us AND (w.start_us + w.end_us) < 2 * d.end_us))
"""
)

SEGMENTS = (
    KEPT
    + """,
g1 AS (SELECT *, CASE WHEN start_us - lag(end_us) OVER (PARTITION BY asset_id ORDER BY word_idx) >= 800000 THEN 1 ELSE 0 END AS cut FROM kept),
g2 AS (SELECT *, sum(cut) OVER (PARTITION BY asset_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) AS island FROM g1),
g3 AS (SELECT asset_id, island, greatest(min(start_us) - 150000, 0) AS start_us, max(end_us) + 150000 AS end_us, count(*) AS n_words,
  string_agg(word, ' ' ORDER BY word_idx) AS text, min(word_idx) AS first_idx, max(word_idx) AS last_idx,
  avg(conf_milli) AS mean_conf FROM g2 GROUP BY 1, 2),
segments AS (SELECT asset_id, CAST(row_number() OVER (PARTITION BY asset_id ORDER BY start_us) AS INTEGER) AS seg_id, start_us, end_us, n_words, text,
  first_idx, last_idx, mean_conf FROM g3 WHERE end_us - start_us >= 300000)
"""
)


def select(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}\n{body.strip()}"
