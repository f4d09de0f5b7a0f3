"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations alone.

Documents fall into cells of source x language x topic. The cells' token weights are raked: scaled to the target share of each
source, then of each language, then of each topic, until no factor differs from 1 by TOLERANCE or more, ROUNDS times at most. A
document of a cell is then kept with probability min(1, scale x target tokens / tokens of the cell), the scale fitted so that the
expected tokens meet the budget.

A topic is a stem: the first STEM letters of words of CONTENT letters or more. The TOPICS stems that most documents have, those
left out that more than WIDEST of all have, are the corpus's topics, and a document's topic is the one it says most often.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import cut, lookup, packed, quoted

#: Marginals and the power of the corpus share that gives a value's target share: 1 keeps the mixture, 0 makes it even.
TEMPER = {"source": 0.7, "lang": 0.7, "topic": 0.8}
ROUNDS, TOLERANCE, SCALINGS, BUDGET = 12, 1e-4, 6, 0.75
TOPICS, STEM, CONTENT, WIDEST = 16, 5, 7, 0.2
NONE, OTHER = "(none)", "(other)"
WORDS = r"[^\x20\x09-\x0D]+"
LONG_WORDS = f"[a-zà-öø-ÿ]{{{CONTENT},}}"


def stems() -> Column:
    """The stems of a text's long words, in order."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(LONG_WORDS), F.lit(0))
    return F.transform(words, lambda w: F.substring(w, 1, STEM))


def find_topics(docs: DataFrame) -> list[str]:
    """The corpus's topics, the most widespread first: TOPICS rows at most, counted over all documents."""
    said = docs.select(F.explode(F.array_distinct(stems())).alias("stem")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    least = said.filter((F.col("n") > 1) & (F.col("n") <= WIDEST * docs.count()))
    return [r.stem for r in least.orderBy(F.desc("n"), "stem").limit(TOPICS).collect()]


def says(topic: str, place: int, found: Column) -> Column:
    return F.struct(F.size(F.filter(found, lambda x: x == topic)).alias("n"), F.lit(-place).alias("place"), F.lit(topic).alias("topic"))


def topic(topics: list[str]) -> Column:
    """The topic a text says most often, of equals the most widespread; OTHER for a text that says none."""
    if not topics:
        return F.lit(OTHER)
    most = lambda found: F.array_max(F.array(*[says(t, k, found) for k, t in enumerate(topics)]))
    best = F.transform(F.array(F.filter(stems(), lambda x: x.isin(topics))), most)[0]
    return F.when(best["n"] > 0, best["topic"]).otherwise(OTHER)


def described(docs: DataFrame, topics: list[str], *keep: Column) -> DataFrame:
    """source, lang, topic, tokens (words) and draw of each row, and the columns in keep."""
    name = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(NONE)).alias(c)
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("long").alias("tokens")
    return docs.select(name("source"), name("lang"), topic(topics).alias("topic"), tokens, *keep)


def cells_of(rows: DataFrame) -> DataFrame:
    """source, lang, topic, n (rows), t (tokens), one row for each cell."""
    return cut(rows.groupBy("source", "lang", "topic").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")))


def targets(cells: DataFrame, temper: dict[str, float]) -> DataFrame:
    """cells with w, their token weights, and for each marginal its value's target share, t_<marginal>."""
    total = float(max(1, cells.agg(F.sum("t")).first()[0] or 0))
    out = cells.withColumn("w", F.col("t") / total)
    for name, power in temper.items():
        h = F.sum("t") / total
        shares = cells.groupBy(name).agg(F.when(h > 0, F.pow(h, F.lit(power))).otherwise(0.0).alias("p"))
        whole = shares.agg(F.sum("p")).first()[0] or 0.0
        out = out.join(shares.select(name, (F.col("p") / whole if whole > 0 else F.lit(0.0)).alias(f"t_{name}")), name)
    return cut(out)


def scaled(rows: DataFrame, name: str) -> DataFrame:
    """rows with w scaled so that each value of a marginal has its target, and e, how much a factor differs from 1 at most so far."""
    share = F.sum("w").over(Window.partitionBy(name))
    factor = F.when(share > 0, F.col(f"t_{name}") / share)
    return rows.withColumn("_f", factor).withColumns({"w": F.coalesce(F.col("w") * F.col("_f"), F.lit(0.0)), "e": F.greatest("e", F.abs(F.col("_f") - 1))}).drop("_f")


def raked(cells: DataFrame, temper: dict[str, float], rounds: int = ROUNDS) -> DataFrame:
    """cells with w: raked token weights that sum to 1, and e: how much the last round's factors differed from 1 at most.

    The first marginal, of which there may be very many values, is scaled where its cells lie together, a few for each value. The
    others are scaled on the sums over it, a table of a row for each language and topic, and their joint factor is joined back; so
    no task gets all cells of a language. Each round's result is cut off.
    """
    first, *others = temper
    out = targets(cells, temper).withColumn("e", F.lit(1.0))
    for _ in range(rounds):
        now = scaled(out.withColumn("e", F.lit(0.0)), first)
        sums = now.groupBy(*others).agg(F.sum("w").alias("w"), F.max("e").alias("e"), *[F.max(f"t_{c}").alias(f"t_{c}") for c in others])
        after = sums.withColumn("_w", F.col("w"))
        for name in others:
            after = scaled(after, name)
        factor = F.when(F.col("_w") > 0, F.col("w") / F.col("_w")).otherwise(0.0)
        after = after.select(*others, factor.alias("_g"), F.col("e").alias("_e"))
        out = cut(now.join(after, others).withColumns({"w": F.col("w") * F.col("_g"), "e": F.greatest("e", "_e")}).drop("_g", "_e"))
        if (out.agg(F.max("e")).first()[0] or 0.0) < TOLERANCE:
            break
    return out


def calibrated(cells: DataFrame, budget: float, scalings: int = SCALINGS) -> DataFrame:
    """cells with p: keeping probabilities whose expected tokens meet `budget` of all, no probability over 1."""
    total = float(cells.agg(F.sum("t")).first()[0] or 0)
    r = F.when(F.col("t") > 0, F.col("w") * total / F.col("t")).otherwise(0.0)
    out, scale = cells.withColumn("r", r), budget
    for _ in range(scalings):
        p = F.least(F.lit(1.0), F.col("r") * scale)
        full, part = out.agg(F.sum(F.when(p >= 1, F.col("t")).otherwise(0)), F.sum(F.when(p < 1, p * F.col("t")).otherwise(0.0))).first()
        if not part:
            break
        was, scale = scale, scale * (total * budget - full) / part
        if abs(scale - was) <= 1e-12 * was:
            break
    return out.withColumn("p", F.when(F.col("t") > 0, F.least(F.lit(1.0), F.col("r") * scale)).otherwise(1.0))


def draw(seed: int) -> Column:
    """A number in [0, 1) that follows from doc_id and the seed: the first 52 bits of an MD5."""
    of = F.md5(F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE)), F.lit(str(seed))))
    return F.conv(F.substring(of, 1, 13), 16, 10).cast("double") / float(1 << 52)


def solved(cells: DataFrame, temper: dict[str, float], budget: float) -> DataFrame:
    """source, lang, topic, n, w (raked weight), p (keeping probability) of each cell."""
    return cut(calibrated(raked(cells, temper), budget).select("source", "lang", "topic", "n", "w", "p"))


def placed(rows: DataFrame, cells: DataFrame, temper: dict[str, float], budget: float) -> DataFrame:
    """rows with their cell's w and p."""
    total = int(cells.agg(F.sum("n")).first()[0] or 0)
    return lookup(rows, solved(cells, temper, budget), ["source", "lang", "topic"], "n", total)


def mix_report(docs: DataFrame, temper: dict[str, float] = TEMPER, budget: float = BUDGET, seed: int = 42) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, cell_weight, probability (both to 6 digits) and sampled, one row for each row of docs.

    A null source or language is the value "(none)"; a null or empty text has no tokens, and a cell without tokens is kept whole.
    Rows with the same doc_id share a draw; all null ids share one. An empty table gives no rows; other columns are not read.
    """
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    rows = cut(described(few, find_topics(few), F.col("doc_id"), draw(seed).alias("draw")))
    out = placed(rows, cells_of(rows), temper, budget)
    weights = F.round("w", 6).alias("cell_weight"), F.round("p", 6).alias("probability")
    return out.select("doc_id", "source", "lang", "topic", F.col("tokens").alias("n_tokens"), *weights, (F.col("draw") < F.col("p")).alias("sampled"))


def marginals(docs: DataFrame, temper: dict[str, float] = TEMPER) -> DataFrame:
    """marginal, value, target, share of tokens after raking, and error (share - target), of each value: how well the targets are met."""
    out = raked(cells_of(described(docs, find_topics(docs))), temper)
    parts = [out.groupBy(F.col(c).alias("value")).agg(F.max(f"t_{c}").alias("target"), F.sum("w").alias("share")).withColumn("marginal", F.lit(c)) for c in temper]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.select("marginal", "value", "target", "share", (F.col("share") - F.col("target")).alias("error"))


def sample(docs: DataFrame, temper: dict[str, float] = TEMPER, budget: float = BUDGET, seed: int = 42) -> DataFrame:
    """The sampled rows of docs, all columns; rows as in mix_report."""
    topics = find_topics(docs)
    rows = described(docs, topics, draw(seed).alias("draw"), packed(docs))
    return placed(rows, cells_of(described(docs, topics)), temper, budget).filter(F.col("draw") < F.col("p")).select("row.*")


def sql(temper: dict[str, float] = TEMPER, budget: float = BUDGET, seed: int = 42) -> str:
    """The same result in DuckDB's SQL, a common table for each step; a round after one that has converged changes nothing."""
    said = f"list_transform(regexp_extract_all(lower(coalesce(text, '')), '{LONG_WORDS}'), lambda w: substring(w, 1, {STEM}))"
    parts = [
        f"d0 AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang, {said} AS said,"
        f" len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents)",
        "f0 AS (SELECT stem, count(*) AS n FROM (SELECT unnest(list_distinct(said)) AS stem FROM d0) GROUP BY 1)",
        f"f1 AS (SELECT stem, row_number() OVER (ORDER BY n DESC, stem) AS place FROM f0 WHERE n > 1 AND n <= {WIDEST} * (SELECT count(*) FROM d0) QUALIFY place <= {TOPICS})",
        "f2 AS (SELECT rid, stem, row_number() OVER (PARTITION BY rid ORDER BY count(*) DESC, min(place)) AS k FROM (SELECT rid, unnest(said) AS stem FROM d0) JOIN f1 USING (stem) GROUP BY 1, 2)",
        f"d AS (SELECT doc_id, source, lang, coalesce(stem, '{OTHER}') AS topic, n_tokens FROM d0 LEFT JOIN (SELECT * FROM f2 WHERE k = 1) USING (rid))",
        "c0 AS (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS t FROM d GROUP BY ALL)",
        "k0 AS (SELECT *, t / greatest(sum(t) OVER (), 1) AS w FROM c0)",
    ]
    at = 0
    for name, power in temper.items():
        parts.append(f"s{at} AS (SELECT *, sum(w) OVER (PARTITION BY {name}) AS h FROM k{at})")
        even = f"sum(CASE WHEN h > 0 THEN pow(h, {power}) * w / h ELSE 0 END) OVER ()"
        parts.append(f"k{at + 1} AS (SELECT * EXCLUDE (h), CASE WHEN h > 0 THEN pow(h, {power}) / {even} ELSE 0 END AS t_{name} FROM s{at})")
        at += 1
    parts.append(f"r0 AS (SELECT *, 1.0::DOUBLE AS e, FALSE AS done FROM k{at})")
    at = 0
    for _ in range(ROUNDS):
        for k, name in enumerate(temper):
            parts.append(f"h{at} AS (SELECT *, CASE WHEN sum(w) OVER (PARTITION BY {name}) > 0 THEN t_{name} / sum(w) OVER (PARTITION BY {name}) END AS q FROM r{at})")
            e = "0" if k == 0 else "e"
            parts.append(f"r{at + 1} AS (SELECT * EXCLUDE (q) REPLACE (CASE WHEN done THEN w ELSE coalesce(w * q, 0) END AS w, CASE WHEN done THEN e ELSE greatest({e}, abs(coalesce(q, 1) - 1)) END AS e) FROM h{at})")
            at += 1
        parts.append(f"r{at + 1} AS (SELECT * REPLACE (max(e) OVER () < {TOLERANCE} AS done) FROM r{at})")
        at += 1
    parts.append(f"p0 AS (SELECT *, least(1.0, CASE WHEN t > 0 THEN w * sum(t) OVER () / t ELSE 0 END * {budget}) AS p FROM r{at})")
    for k in range(SCALINGS):
        parts.append(f"q{k} AS (SELECT *, sum(CASE WHEN p >= 1 THEN t ELSE 0 END) OVER () AS f, sum(CASE WHEN p < 1 THEN p * t ELSE 0 END) OVER () AS g, sum(t) OVER () AS a FROM p{k})")
        scaled = f"p * CASE WHEN g > 0 THEN (a * {budget} - f) / g ELSE 1.0 END"
        parts.append(f"p{k + 1} AS (SELECT * EXCLUDE (f, g, a) REPLACE (CASE WHEN p >= 1 THEN 1.0 ELSE least(1.0, {scaled}) END AS p) FROM q{k})")
    parts.append(f"cells AS (SELECT source, lang, topic, w, CASE WHEN t > 0 THEN p ELSE 1.0 END AS p FROM p{SCALINGS})")
    parts = [p.replace(" AS (", " AS MATERIALIZED (", 1) for p in parts]
    draws = f"('0x' || substr(md5(concat_ws('/', coalesce(doc_id::VARCHAR, '{NONE}'), '{seed}')), 1, 13))::BIGINT / 4503599627370496.0"
    out = f"SELECT doc_id, source, lang, topic, n_tokens, round(w, 6) AS cell_weight, round(p, 6) AS probability, {draws} < p AS sampled"
    return "WITH " + ",\n".join(parts) + f"\n{out} FROM d JOIN cells USING (source, lang, topic)"
