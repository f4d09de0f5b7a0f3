"""Phrases of a corpus: the most widespread, and those whose share moved over periods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import phrases as P
from folioforge.plans.registry import Tables, query

_STOPS = ", ".join(f"'{w}'" for w in P.STOPS)


def _runs(words: str, least: int, most: int) -> str:
    """SQL: doc_id, p, n, i of each run of `words`, an array column of d."""
    return f"SELECT *, array_to_string(w[i:i + n - 1], ' ') AS p FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, {words} AS w FROM d) AS d, (SELECT unnest(range({least}, {most + 1})) AS n) AS sizes WHERE len(w) >= n)"


@query(
    "X16_top_phrases",
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9-]+') AS words FROM documents),
g AS ({_runs("words", 3, 6)}),
c AS (
  SELECT p, n, count(DISTINCT doc_id) AS docs, count(*) AS occurrences, min({{'d': doc_id, 'i': i}}) AS first
  FROM g WHERE w[i] NOT IN ({_STOPS}) AND w[i + n - 1] NOT IN ({_STOPS}) GROUP BY p, n HAVING count(DISTINCT doc_id) >= 2
),
inner_runs AS (
  SELECT DISTINCT docs, array_to_string(w[a:a + m - 1], ' ') AS p
  FROM (SELECT docs, w, m, unnest(range(1, n - m + 2)) AS a FROM (SELECT docs, n, string_split(p, ' ') AS w FROM c) AS c, (SELECT unnest(range(3, 6)) AS m) AS sizes WHERE m < n)
)
SELECT p AS phrase, docs, occurrences::BIGINT AS occurrences, n::INT AS n, row_number() OVER (ORDER BY docs DESC, n DESC, occurrences DESC, first)::INT AS rank
FROM c ANTI JOIN inner_runs USING (p, docs) QUALIFY rank <= 40
""",
)
def _(t: Tables) -> DataFrame:
    """Words may have hyphens; every other character parts them."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9-]+"), F.lit(0))
    return P.top_phrases(t.documents.select("doc_id", F.coalesce(words, F.array().cast("array<string>")).alias("words")))


_SHARES = [f"share_{i}" for i in range(5)]
_EDGES = (500, 1000, 2000, 4000)


def _collapse(direction: str, net: str, share: str) -> str:
    """SQL: phrases in the order of their shift in one direction."""
    return f"""
SELECT '{direction}' AS direction, row_number() OVER (ORDER BY {net} DESC, n DESC, length(p) DESC, {share} DESC, p) AS rank, * FROM moved"""


@query(
    "X17_shifted_phrases",
    rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '\s+', ' ', 'g')), '[a-z0-9'']+') AS words,
    CASE WHEN n_chars < 500 THEN 0 WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 WHEN n_chars < 4000 THEN 3 ELSE 4 END AS k
  FROM documents
), total AS (SELECT k, count(*) AS total FROM d GROUP BY k),
g AS ({_runs("words", 2, 15)}),
c AS (
  SELECT p, n, {", ".join(f"count(*) FILTER (WHERE k = {i}) / (SELECT total FROM total WHERE k = {i}) AS share_{i}" for i in range(5))}
  FROM (SELECT DISTINCT doc_id, k, p, n FROM g) GROUP BY p, n HAVING greatest({", ".join(f"count(*) FILTER (WHERE k = {i})" for i in range(5))}) >= 10
), moved AS (
  SELECT *, share_4 - share_0 AS delta FROM c
  WHERE greatest({", ".join(_SHARES)}) >= 0.05 AND abs(share_4 - share_0) >= 0.10 AND regexp_matches(p, '[a-z]') AND NOT regexp_full_match(p, '(section|sections|article|articles) [a-z0-9 ]+')
    AND len(list_filter(string_split(p, ' '), lambda w: regexp_full_match(w, '[0-9]+(st|nd|rd|th)?'))) < greatest(2, n - 1)
), ranked AS ({_collapse("addition", "delta", "share_4")} UNION ALL {_collapse("deletion", "-delta", "share_0")}
), nested AS (
  SELECT s.direction, s.rank, min(l.rank) AS earliest, min(l.rank) FILTER (WHERE l.rank > s.rank) AS goes
  FROM ranked AS s JOIN ranked AS l ON s.direction = l.direction AND l.n > s.n AND contains(' ' || l.p || ' ', ' ' || s.p || ' ') GROUP BY ALL
), live AS (SELECT ranked.*, goes FROM ranked LEFT JOIN nested USING (direction, rank) WHERE earliest IS NULL OR earliest > rank
), held AS (
  SELECT a.direction, a.rank, count(*) AS held FROM live AS a JOIN live AS b ON a.direction = b.direction AND b.rank <= a.rank AND coalesce(b.goes > a.rank, TRUE) GROUP BY ALL
), stop AS (SELECT direction, min(rank) AS stop FROM held WHERE held >= 15 GROUP BY direction)
SELECT direction, rank::INT AS rank, p AS phrase, n::INT AS n, {", ".join(f"round({s}, 8) AS {s}" for s in _SHARES)}, round(delta, 8) AS delta,
  CASE WHEN delta >= 0.10 AND least(share_1 - share_0, share_2 - share_1, share_3 - share_2, share_4 - share_3) >= -0.05 THEN 'steady increase'
    WHEN delta <= -0.10 AND greatest(share_1 - share_0, share_2 - share_1, share_3 - share_2, share_4 - share_3) <= 0.05 THEN 'steady decrease'
    WHEN greatest(abs(share_1 - share_0), abs(share_2 - share_1), abs(share_3 - share_2)) < 0.05 AND share_4 - share_3 >= 0.10 THEN 'late jump'
    WHEN greatest(share_1, share_2, share_3) >= share_0 + 0.10 AND greatest(share_1, share_2, share_3) >= share_4 + 0.10 THEN 'mid-period spike' ELSE 'mixed' END AS shape
FROM live LEFT JOIN stop USING (direction)
WHERE (stop IS NULL AND goes IS NULL) OR (rank <= stop AND coalesce(goes > stop, TRUE))
""",
)
def _(t: Tables) -> DataFrame:
    """Five periods by length: the share of a phrase in ever longer documents."""
    k = F.when(F.col("n_chars") < _EDGES[0], 0).when(F.col("n_chars") < _EDGES[1], 1).when(F.col("n_chars") < _EDGES[2], 2).when(F.col("n_chars") < _EDGES[3], 3).otherwise(4)
    words = F.split(T.phrase_text(F.coalesce("text", F.lit(""))), " ")
    docs = t.documents.select("doc_id", k.alias("k"), F.filter(words, lambda w: w != "").alias("words"))
    out = P.shifted_phrases(docs, "k", range(5), T.noisy_phrase)
    return out.withColumns({c: F.round(c, 8) for c in (*_SHARES, "delta")})
