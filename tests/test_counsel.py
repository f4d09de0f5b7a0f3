"""Firm names: joint names, aliases, forms and places at the end."""

from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import counsel as C


def test_shown_names_and_keys(spark):
    cases = {
        "Alpha & Beta LLP (US)": ("Alpha & Beta", "alpha beta"), " ; Gamma and Delta, P.C., Inc. ;": ("Gamma & Delta", "gamma delta"), "LLP": ("LLP", ""), ", LLP": ("LLP", ""),
        "Epsilon Professional Corporation": ("Epsilon", "epsilon"), "Zeta  (NY) LLC": ("Zeta", "zeta"), "Eta (Paris)": ("Eta (Paris)", "eta paris"), "A.B.C.": ("A.B.C.", "a b c"),
    }
    rows = spark.createDataFrame([(x,) for x in cases], "n string").select("n", T.firm_display(F.col("n")).alias("d"), T.counsel_key(T.firm_display(F.col("n"))).alias("k")).collect()
    assert {r.n: (r.d, r.k) for r in rows} == cases


def test_joint_names_are_split_in_order(spark):
    joint = spark.createDataFrame([("Ash & Oak LLP, Elm US", ["Ash & Oak", "Elm"]), ("fir pine", ["Fir", "Pine"])], "name string, firms array<string>")
    rows = spark.createDataFrame([(1, "Ash & Oak LLP, Elm US; Birch LLP and Yew Inc."), (2, "Fir & Pine P.C.\nCedar"), (3, None), (4, " ;; "), (5, "L.L.P. and X")], "id int, field string")
    got = C.split_names(rows, "field", joint).orderBy("id", "place").collect()
    assert [(r.id, r.firm) for r in got] == [(1, "Ash & Oak"), (1, "Elm"), (1, "Birch LLP"), (1, "Yew Inc."), (2, "Fir"), (2, "Pine"), (2, "Cedar"), (5, "L.L.P. and X")]


def test_aliases_by_name_then_by_key(spark):
    aliases = spark.createDataFrame([("Rimon Law", "Rimon"), ("rimon law", "Other"), ("Ash Tree", "Ash & Co LLP")], "name string, instead string")
    rows = spark.createDataFrame([("Rimon Law LLP",), ("RIMON LAW",), ("ash tree",), ("Fir Tree",), (None,), (" , ",)], "n string")
    got = {r.n: r.firm_key for r in C.canonical_names(rows, "n", aliases).collect()}
    assert got == {"Rimon Law LLP": "rimon", "RIMON LAW": "other", "ash tree": "ash co", "Fir Tree": "fir tree", None: None, " , ": None}
