"""Windows and ordered sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators import sequence as S
from folioforge.plans.registry import Tables, query

TURNS = "SELECT conv_id, turn, role, length(text) AS n FROM conversations"


def turns(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n"))


@query("W1_first_rows", f"SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM ({TURNS})) WHERE role = 'system' OR r <= 2")
def _(t: Tables) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy("turn"))
    return turns(t).withColumn("r", r).filter("role = 'system' OR r <= 2").select("conv_id", "turn")


@query("W2_preview_rank", "SELECT l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber) AS r FROM lineitem) WHERE r <= 3")
def _(t: Tables) -> DataFrame:
    return S.first_n(t.lineitem, ["l_orderkey"], ["l_shipdate", "l_linenumber"], 3).select("l_orderkey", "l_linenumber")


@query(
    "W3_neighbours",
    f"""SELECT *, abs(n - prev_n) AS prev_n_delta, abs(n - next_n) AS next_n_delta FROM (SELECT conv_id, turn, n, coalesce(lag(n) OVER w, 0) AS prev_n, coalesce(lead(n) OVER w, 0) AS next_n FROM ({TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
)
def _(t: Tables) -> DataFrame:
    return S.neighbours(turns(t), "conv_id", "turn", ["n"]).drop("role")


@query(
    "W4_since_last",
    f"""SELECT conv_id, turn, o - l AS since, l IS NOT NULL AS seen, recent_hits::BIGINT AS recent_hits FROM (SELECT *, max(CASE WHEN n > 500 THEN o END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS l,
    sum((n > 500)::INT) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent_hits FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM ({TURNS})))""",
)
def _(t: Tables) -> DataFrame:
    return S.since_last(turns(t), "conv_id", "turn", F.col("n") > 500).select("conv_id", "turn", F.col("since").cast("long").alias("since"), "seen", "recent_hits")


@query(
    "W5_relative_position",
    f"""SELECT conv_id, turn, CASE WHEN c > 1 THEN round((k - 1) / (c - 1), 8) ELSE 0 END AS position, k <= ceil(c * 0.1::DOUBLE) AS first_decile, k > c - ceil(c * 0.1::DOUBLE) AS last_decile,
    k <= ceil(c * 0.2::DOUBLE) AS first_quintile, k > c - ceil(c * 0.2::DOUBLE) AS last_quintile FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM ({TURNS}))""",
)
def _(t: Tables) -> DataFrame:
    return S.relative_position(turns(t), "conv_id", "turn").drop("role", "n").withColumn("position", F.round("position", 8))


@query("W6_monotone_clamp", f"SELECT conv_id, turn, max(r) OVER w AS clamped, max(r) OVER w <> r AS modified FROM (SELECT *, n % 5 AS r FROM ({TURNS})) WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def _(t: Tables) -> DataFrame:
    return S.monotone_clamp(turns(t).withColumn("r", F.col("n") % 5), "conv_id", "turn", "r").select("conv_id", "turn", "clamped", "modified")


@query(
    "W7_relabel_early_run",
    f"""SELECT conv_id, turn, CASE WHEN role = 'user' AND max(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) = 0
    AND row_number() OVER (PARTITION BY conv_id ORDER BY turn) / count(*) OVER (PARTITION BY conv_id) <= 0.5 THEN 'opening' ELSE role END AS relabelled FROM ({TURNS})""",
)
def _(t: Tables) -> DataFrame:
    return S.relabel_early_run(turns(t), "conv_id", "turn", "role", "user", "assistant", "opening").select("conv_id", "turn", "relabelled")


_RUNS = """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS b FROM events)"""


@query("W8_longest_runs", f"{_RUNS} SELECT user_id, event_type, max(n) AS longest FROM (SELECT user_id, event_type, a - b AS g, count(*) AS n FROM e GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    rows = t.events.withColumn("place", F.struct("ts", "event_id"))
    return S.longest_runs(rows, "user_id", "place", "event_type")


@query("W9_keep_first", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.first_n(t.documents, ["source"], ["doc_id"], 1).select("source", "doc_id")


@query("W10_keep_last", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return S.keep_last(t.events, ["user_id"], "event_id").select("user_id", "event_id")


@query("W11_sequence_gaps", f"SELECT conv_id, turn, num, expected FROM (SELECT *, coalesce(lag(num) OVER (PARTITION BY conv_id ORDER BY turn) + 1, 1) AS expected FROM (SELECT conv_id, turn, CASE WHEN n > 100 THEN turn + 1 ELSE turn + 2 END AS num FROM ({TURNS}))) WHERE num <> expected")
def _(t: Tables) -> DataFrame:
    rows = turns(t).select("conv_id", "turn", F.when(F.col("n") > 100, F.col("turn") + 1).otherwise(F.col("turn") + 2).alias("num"))
    return S.sequence_gaps(rows, "conv_id", "turn", "num")


@query("W12_out_of_order", f"SELECT conv_id, turn FROM (SELECT *, max(n) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({TURNS})) WHERE n < m")
def _(t: Tables) -> DataFrame:
    return S.out_of_order(turns(t), "conv_id", "turn", "n").select("conv_id", "turn")


@query("W13_context_titles", f"SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after FROM ({TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY coalesce(turn, -1))")
def _(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.coalesce("turn", F.lit(-1)))
    return turns(t).select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))


@query("W14_monotone_decode")
def _(t: Tables) -> DataFrame:
    scored = turns(t).select("conv_id", "turn", *[(-F.abs(F.col("n") % 7 - 2 * k)).cast("double").alias(f"s{k}") for k in range(4)])
    return S.decode_monotone(scored, "conv_id", "turn", [f"s{k}" for k in range(4)])


@query("W15_averaged_windows", "SELECT conv_id, position, round(avg(v), 8) AS logit FROM (SELECT conv_id, turn * 2 + unnest([0, 1, 2]) AS position, unnest([length(text), length(text) * 2, 1])::DOUBLE AS v FROM conversations) GROUP BY 1, 2")
def _(t: Tables) -> DataFrame:
    windows = turns(t).select("conv_id", (F.col("turn") * 2).alias("start"), F.array(F.col("n").cast("double"), F.col("n") * 2.0, F.lit(1.0)).alias("logits"))
    return S.averaged_windows(windows, "conv_id", "start", "logits").withColumn("logit", F.round("logit", 8))


@query(
    "A24_review_summary",
    f"""WITH p AS (SELECT conv_id, turn, role, (n % 97) / 97 AS c FROM ({TURNS})), f AS (SELECT *, c < 0.3 AS low, role IS DISTINCT FROM coalesce(lag(role) OVER w, role) AS change, row_number() OVER w AS a, row_number() OVER (PARTITION BY conv_id, c < 0.3 ORDER BY turn) AS b FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT conv_id, max(k) AS longest FROM (SELECT conv_id, a - b AS g, count(*) AS k FROM f WHERE low GROUP BY 1, 2) GROUP BY 1),
    s AS (SELECT conv_id, count(*) AS pages, avg(c) AS mean, min(c) AS least, list_avg(list_sort(list(c))[1:3]) AS worst3, count(*) FILTER (WHERE low) AS low_pages, count(*) FILTER (WHERE change) AS changes FROM f GROUP BY 1)
    SELECT conv_id, pages, round(mean, 8) AS mean_confidence, round(least, 8) AS least_confidence, round(worst3, 8) AS worst3, low_pages, changes, coalesce(longest, 0) AS longest_low_run,
    round(0.5 * (1 - worst3) + 0.3 * low_pages / pages + 0.2 * least(1, coalesce(longest, 0) / 5), 8) AS review_score FROM s LEFT JOIN r USING (conv_id)""",
)
def _(t: Tables) -> DataFrame:
    pages = turns(t).withColumn("c", (F.col("n") % 97) / 97.0)
    out = S.review_summary(pages, "conv_id", "turn", "role", "c", 0.3)
    return out.withColumns({c: F.round(c, 8) for c in ("mean_confidence", "least_confidence", "worst3", "review_score")})


_PROBS = "(1 + {x}) / (15.0 + n % 5 + n % 7 + n % 11 + n % 3 + n % 13 - 10)"


def page_probabilities(t: Tables) -> DataFrame:
    """Made-up label probabilities of each turn, from its length."""
    mods = {"front": 5, "toc": 7, "body": 11, "sig": 3, "back": 13}
    n = F.col("n")
    total = sum((1 + n % m for m in mods.values()), F.lit(0))
    return turns(t).select("conv_id", "turn", *[((1 + n % m) / total).alias(c) for c, m in mods.items()])


@query("A24_review_features")
def _(t: Tables) -> DataFrame:
    return S.review_features(page_probabilities(t), "conv_id", "turn", {c: c for c in ("front", "toc", "body", "sig", "back")}, "body", "back")


@query("W14_bioes_decode")
def _(t: Tables) -> DataFrame:
    labels = S.bioes_labels(["article", "section"])
    scored = turns(t).select("conv_id", "turn", *[(-F.abs(F.col("n") % 11 - k)).cast("double").alias(f"s{k}") for k in range(len(labels))])
    return S.decode_bioes(scored, "conv_id", "turn", [f"s{k}" for k in range(len(labels))], ["article", "section"])
