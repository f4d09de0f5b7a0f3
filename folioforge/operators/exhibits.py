"""Exhibits: features of a document's words and title region, and a classifier of them trained with Spark ML."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, Normalizer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import let
from folioforge.operators import likeness
from folioforge.operators.sets import written

#: Phrases of the subject, looked for in the whole text.
SUBJECT = (
    "merger", "acquisition", "merger agreement", "stock purchase", "asset purchase", "merger consideration", "surviving corporation", "constituent corporations", "merger sub", "tender offer",
    "exchange ratio", "merger closing", "effective time", "dissenting shares", "appraisal rights", "cash merger", "stock merger", "reverse merger", "triangular merger", "short form merger",
    "representations and warranties", "covenants", "closing conditions", "material adverse change", "mac", "material adverse effect", "mae", "termination fee", "break up fee", "collar",
    "walk away rights", "fairness opinion", "solvency opinion", "proxy statement", "definitive agreement", "due diligence", "antitrust clearance", "hsr act", "regulatory approval",
    "stockholder approval", "board recommendation", "go shop", "no shop", "matching rights", "superior proposal",
)
#: Titles of the wanted documents, looked for at the start.
TITLES = (
    "agreement and plan of amalgamation", "agreement and plan of merger", "agreement and plan of reorganization", "agreement of merger", "asset purchase agreement", "business combination agreement",
    "equity purchase agreement", "interest purchase agreement", "membership interest purchase agreement", "merger agreement", "plan of merger", "purchase and sale agreement", "purchase agreement",
    "securities purchase agreement", "share purchase agreement", "stock purchase agreement", "stock purchase and sale agreement",
)
#: Phrases that speak against a document at its start.
AGAINST = (
    "agreement of limited partnership", "amended and restated", "amendment", "co-operation agreement", "commercial lease", "compensation", "confidentiality agreement", "consulting agreement",
    "contractor agreement", "convertible note", "cooperation agreement", "covenant agreement", "credit agreement", "deferred compensation", "distribution agreement", "employee stock",
    "employment agreement", "equity plan", "exchange agreement", "exhibit", "general release of claims", "guaranty", "incentive", "indemnification agreement", "indemnity agreement",
    "investment management trust agreement", "joint venture agreement", "lease agreement", "letter agreement", "letter of intent", "license agreement", "limited partnership agreement", "loan agreement",
    "loan and security agreement", "loan term", "management agreement", "master lease", "memorandum agreement", "memorandum of understanding", "non-competition", "non-solicitation agreement",
    "note purchase", "option", "performance", "please see pdf version", "private placement", "promissory note", "real estate", "registration rights", "restricted shares", "restricted stock",
    "retirement plan", "royalty", "schedule", "securities subscription agreement", "secured note", "senior secured", "separation", "separation and general release agreement", "service agreement",
    "services agreement", "shareholder rights agreements", "side letter agreement", "sponsor agreement", "sponsorship agreement", "subscription agreement", "supply agreement", "support agreement",
    "support letter", "term loan", "termination agreement", "transition services", "underwriting agreement", "voting agreement", "warrant",
)
#: Characters that are the start; characters below which a document is none of the wanted ones, whatever it says.
START, SHORT = 2000, 20_000
FEATURES = ("n_words", "subject_hits", "subject_density", "title_hit", "title_place", "against_hit", "against_count", "against_place", "against_caps", "against_caps_count")


def scanned(text: Column, fold: bool = True) -> Column:
    """Letters, digits and single blanks."""
    plain = F.lower(text) if fold else text
    return F.trim(F.regexp_replace(plain, "[^A-Za-z0-9]+", " "))


def spread(text: Column) -> Column:
    """Blanks doubled, and one at either end, so that phrases next to each other do not share one."""
    return F.concat(F.lit(" "), F.replace(text, F.lit(" "), F.lit("  ")), F.lit(" "))


def phrase_of(words: str) -> str:
    """A phrase as `scanned` leaves it: a hyphen parts words."""
    return " ".join(words.replace("-", " ").split())


def looks(text: Column, subject: Sequence[str] = SUBJECT, titles: Sequence[str] = TITLES, against: Sequence[str] = AGAINST, start: int = START) -> Column:
    """What `features` are made of, as one column. Words; how many of the subject's phrases stand in the text, and their density; whether, and where, a title stands in the first
    `start` characters, and how often, and where, a phrase against it does, in any case and in capitals. Phrases are whole words, titles
    may begin or end inside one. Places are shares of the region's length."""
    text = F.coalesce(text, F.lit(""))
    words = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))

    def scans(t: Column) -> Column:
        region = scanned(F.substring(F.lower(t), 1, start))
        return F.struct(spread(scanned(t)).alias("whole"), region.alias("region"), spread(region).alias("wide"), spread(scanned(F.substring(t, 1, start), False)).alias("cased"), F.concat(F.lit(" "), region, F.lit(" ")).alias("edged"))

    def looked_at(v: Column) -> Column:
        region = v["region"]
        inside = lambda p: F.lit(f" {phrase_of(p).replace(' ', '  ')} ")
        count = lambda where, p: ((F.length(where) - F.length(F.replace(where, p, F.lit("")))) / F.length(p)).cast("int")
        upper = lambda p: F.lit(f" {phrase_of(p).upper().replace(' ', '  ')} ")
        first = lambda places: F.array_min(F.filter(F.array(*places), lambda k: k > 0)) - 1
        return F.struct(
            sum((F.contains(v["whole"], inside(p)).cast("int") for p in subject), F.lit(0)).alias("hits"), first([F.instr(region, p) for p in titles]).alias("title"),
            first([F.instr(v["edged"], f" {phrase_of(p)} ") for p in against]).alias("other"), sum((count(v["wide"], inside(p)) for p in against), F.lit(0)).alias("n"),
            sum((count(v["cased"], upper(p)) for p in against), F.lit(0)).alias("caps"), F.greatest(F.length(region), F.lit(1)).alias("size"),
        )

    # a scan is made once, not for every phrase
    found = let(let(text, scans), looked_at)
    return F.struct(words.alias("words"), found.alias("found"))


def features(seen: str) -> dict[str, Column]:
    """FEATURES, from a column of `looks`."""
    words = F.col(f"{seen}.words")
    hits, title, other, n, caps, size = (F.col(f"{seen}.found.{c}") for c in ("hits", "title", "other", "n", "caps", "size"))
    return {
        "n_words": words, "subject_hits": hits, "subject_density": F.when(words > 0, hits / words).otherwise(0.0), "title_hit": title.isNotNull().cast("int"), "title_place": F.coalesce(title / size, F.lit(0.0)),
        "against_hit": (n > 0).cast("int"), "against_count": n, "against_place": F.coalesce(other / size, F.lit(0.0)), "against_caps": (caps > 0).cast("int"), "against_caps_count": caps,
    }


def featured(docs: DataFrame, text: str = "text", kind: str | None = "double") -> DataFrame:
    """docs with FEATURES, as numbers of a kind, or each of its own."""
    return docs.withColumn("_seen", looks(F.col(text))).withColumns({c: v.cast(kind) if kind else v for c, v in features("_seen").items()}).drop("_seen")


_SUBJECT = tuple(f" {phrase_of(p).replace(' ', '  ')} " for p in SUBJECT)
_AGAINST = tuple((f" {phrase_of(p)} ", f" {phrase_of(p).replace(' ', '  ')} ", f" {phrase_of(p).upper().replace(' ', '  ')} ") for p in AGAINST)
_OTHER, _WORD = re.compile("[^A-Za-z0-9]+"), re.compile(r"\S+", re.ASCII)


def numbers(text: str | None) -> tuple[float, ...]:
    """FEATURES of one text, as `features` has them: some two hundred searches for short phrases, many times as fast in Python's strings as
    in columns."""
    text = text or ""
    plain = lambda t: _OTHER.sub(" ", t).strip(" ")
    wide = lambda t: f" {t.replace(' ', '  ')} "
    low = text.lower()
    whole, region, cased = wide(plain(low)), plain(low[:START]), wide(plain(text[:START]))
    edged, spaced, words = f" {region} ", wide(region), sum(1 for _ in _WORD.finditer(text))
    hits = sum(p in whole for p in _SUBJECT)
    title = min((k for k in map(region.find, TITLES) if k >= 0), default=None)
    other = min((k for k in (edged.find(p) for p, _, _ in _AGAINST) if k >= 0), default=0)
    n, caps, size = sum(spaced.count(p) for _, p, _ in _AGAINST), sum(cased.count(p) for _, _, p in _AGAINST), max(1, len(region))
    return (words, hits, hits / words if words else 0.0, title is not None, (title or 0) / size, n > 0, n, other / size, caps > 0, caps)


def classifier(strength: float = 0.01) -> Pipeline:
    """Logistic regression on the features, on the likeness to the training texts, on runs of 1 to 3 words without stop words, and on runs
    of 3 to 5 characters inside a word and the blanks beside it; runs are hashed and weighted by IDF, rows by how rare their label is."""
    stages = []
    for c in ("terms", "runs"):
        stages += [IDF(inputCol=f"_{c}_tf", outputCol=f"_{c}_idf", minDocFreq=2), Normalizer(inputCol=f"_{c}_idf", outputCol=f"_{c}_unit")]
    stages += [VectorAssembler(inputCols=[*FEATURES, *likeness.STATISTICS], outputCol="_plain"), StandardScaler(inputCol="_plain", outputCol="_scaled"), VectorAssembler(inputCols=["_scaled", "_terms_unit", "_runs_unit"], outputCol="_all")]
    return Pipeline(stages=[*stages, LogisticRegression(featuresCol="_all", labelCol="label", weightCol="weight", probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_guess", regParam=strength)])


def prepared(docs: DataFrame, key: str, like: likeness.Likeness) -> DataFrame:
    """docs (key, text and more) with the features, the likeness and the counts of runs in place of the text, and its `_size`. key tells
    rows apart. Nothing is joined or shuffled: all is worked out where the text is."""
    sized = docs.withColumn("_size", F.length(F.coalesce("text", F.lit(""))))
    return likeness.with_counts(sized, key, like, "_terms_tf", "_runs_tf", FEATURES, numbers)


def fit(labelled: DataFrame, key: str, most: int = likeness.MOST) -> tuple[PipelineModel, likeness.Likeness]:
    """A classifier of labelled documents (key, text, label 0/1), and the likeness it needs, to at most `most` of them; rows without a
    label are not used. Both labels weigh the same."""
    rows = labelled.select(key, F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("double").alias("label")).filter("label IS NOT NULL")
    counts = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        raise ValueError("both labels are needed")
    like = likeness.fit(rows, key, most=most)
    weight = F.create_map(*[F.lit(x) for label, n in counts.items() for x in (label, sum(counts.values()) / (len(counts) * n))])
    # each step of the fit goes through the rows, so they are made once and written: counts, which take less room than their weights
    return classifier().fit(written(prepared(rows.withColumn("weight", weight[F.col("label")]), key, like), "exhibits")), like


def predict(fitted: tuple[PipelineModel, likeness.Likeness], docs: DataFrame, key: str, threshold: float = 0.5, short: int = SHORT) -> DataFrame:
    """key, probability, positive; a text of fewer than `short` characters has probability 0."""
    model, like = fitted
    scored = model.transform(prepared(docs.select(key, "text"), key, like))
    probability = F.when(F.col("_size") < short, 0.0).otherwise(vector_to_array("_p")[1])
    return scored.select(key, probability.alias("probability")).withColumn("positive", F.col("probability") >= threshold)
