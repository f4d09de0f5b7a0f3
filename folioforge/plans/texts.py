"""Scalar functions on text, dates, numbers, arrays and JSON."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.plans.registry import Tables, query


def docs(t: Tables, **columns) -> DataFrame:
    return t.documents.select("doc_id", *[c.alias(k) for k, c in columns.items()])




@query("T1_fingerprint", r"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS fp FROM documents")
def _(t: Tables) -> DataFrame:
    return docs(t, fp=T.fingerprint(F.col("text")))


SHINGLES = "SELECT doc_id, list_distinct(CASE WHEN len(w) < 5 THEN w ELSE [array_to_string(w[i:i+4], ' ') FOR i IN range(1, len(w) - 3)] END) AS s FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents)"


@query("T2_shingle_counts", f"SELECT doc_id, len(s)::INT AS n FROM ({SHINGLES})")
def _(t: Tables) -> DataFrame:
    return docs(t, n=F.size(T.shingles(F.col("text"))))


_ODD = "chr(13) || chr(10) || ' A' || chr(8203) || 'B' || chr(8238) || chr(160) || chr(8195) || 'C ' || chr(10) || chr(9) || chr(10) || ' D' || chr(13) || 'E ' || chr(7) || chr(10)"


@query(
    "T3_normalised",
    rf"""
WITH a AS (SELECT doc_id, replace(replace(text || {_ODD}, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS x FROM documents),
b AS (SELECT doc_id, regexp_replace(regexp_replace(x, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g'), '[\x{{200B}}-\x{{200F}}\x{{202A}}-\x{{202E}}\x{{2060}}\x{{FEFF}}]', '', 'g') AS x FROM a),
c AS (SELECT doc_id, regexp_replace(x, '[\t \x{{85}}\p{{Z}}]+', ' ', 'g') AS x FROM b),
d AS (SELECT doc_id, replace(replace(regexp_replace(x, '\n *(?:\n *)+', '__NL__', 'g'), chr(10), ' '), '__NL__', chr(10) || chr(10)) AS x FROM c)
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, ' {{2,}}', ' ', 'g'), ' +\n', chr(10), 'g'), '\n +', chr(10), 'g'), ' ' || chr(10)) AS plain FROM d
""",
)
def _(t: Tables) -> DataFrame:
    odd = "\r\n A\u200bB\u202e\u00a0\u2003C \n\t\n D\rE \u0007\n"
    return docs(t, plain=T.normalised(F.concat("text", F.lit(odd))))


@query(
    "T4_tight_quotes",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'the "Term ' || doc_id || '" x' WHEN 1 THEN 'x " - " Not " y' WHEN 2 THEN 'a" Beside "and (“ Loan”) z' ELSE 'see " Open' END
    || ' ' || replace(text, '"', '') AS q FROM documents""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit('the "\tTerm '), "doc_id", F.lit('  " x'))).when(k == 1, 'x " - " Not " y').when(k == 2, 'a" Beside " and (“ Loan ”) z').otherwise('see " Open')
    return docs(t, q=T.tight_quotes(F.concat_ws(" ", said, F.replace("text", F.lit('"'), F.lit("")))))


_PLAIN = r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'),
    '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS plain FROM pages"""


@query("T8_stripped_tags", _PLAIN)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.stripped_tags(F.col("html")).alias("plain"))


#: Headings of articles and of sections, with and without numbers, and what is left of them.
_ARTICLES = ("ARTICLE IV.  Tax-Matters", "Article ONE The Merger", "article 12 Conditions (a/b) of “Closing”", "ARTICLE Closing", "ARTICLE Indemnity", "Miscellaneous...", "")
_ARTICLES_PLAIN = ("tax-matters", "the merger", "conditions (a/b) of closing", "osing", "ndemnity", "miscellaneous", "")
_SECTIONS = ("Section 6.10.2. No Shop; Exceptions. .", "Section Indemnity", " section 3 2 Liability caps", "6.10 Plain  Title", "Section 7Tax / Return-Filing (Été)", "", "Section Closing")
_SECTIONS_PLAIN = ("no shop exceptions", "section indemnity", "liability caps", "plain title", "tax / return-filing (été)", "", "section closing")


def chosen(values: Sequence[str], key: str) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _pick(values: Sequence[str], key: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{key} % {len(values)} + 1]"


@query("T9_titles", f"SELECT o_orderkey, {_pick(_ARTICLES_PLAIN, 'o_orderkey')} AS article, {_pick(_SECTIONS_PLAIN, 'o_custkey')} AS section FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.article_title(chosen(_ARTICLES, "o_orderkey")).alias("article"), T.section_title(chosen(_SECTIONS, "o_custkey")).alias("section"))


#: SQL of party_name, of the column in place of {x}.
_PARTY = """array_to_string(list_filter(string_split(regexp_replace(trim(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9&\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '(?:(?:^| )(?:INC|INCORPORATED|CORP|CORPORATION|CO|COMPANY|LLC|LP|LLP|LTD|LIMITED|PLC|NV|BV|SA|AG|GMBH))+$', ''), ' '), lambda w: w <> '' AND w NOT IN ('THE', 'AND', 'OF', 'A', 'AN')), ' ')"""
_NAMES = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'The ' || p_name || ', Inc.' WHEN 1 THEN p_name || ' Holdings Corp' WHEN 2 THEN p_brand || ' & ' || p_name || ' Co., LLC' WHEN 3 THEN 'Inc. of ' || p_type WHEN 4 THEN p_type || ' plc' ELSE 'A.' || p_name END AS name FROM part"


def company_names(t: Tables) -> DataFrame:
    k, f = F.col("p_partkey") % 6, F.concat
    name = F.when(k == 0, f(F.lit("The "), "p_name", F.lit(", Inc."))).when(k == 1, f("p_name", F.lit(" Holdings Corp"))).when(k == 2, f("p_brand", F.lit(" & "), "p_name", F.lit(" Co., LLC"))).when(k == 3, f(F.lit("Inc. of "), "p_type")).when(k == 4, f("p_type", F.lit(" plc")))
    return t.part.select("p_partkey", F.coalesce(name, f(F.lit("A."), "p_name")).alias("name"))


@query("T10_party_names", f"SELECT p_partkey, {_PARTY.format(x='name')} AS party FROM ({_NAMES})")
def _(t: Tables) -> DataFrame:
    return company_names(t).select("p_partkey", T.party_name(F.col("name")).alias("party"))


_COVERS = "SELECT d.doc_id, CASE WHEN d.doc_id % 5 = 0 THEN d.text ELSE 'by and among ' || regexp_replace(p_name, '^.', upper(substring(p_name, 1, 1))) || ' North Corp. and  Beta ' || p_brand || ' LLC, the Gamma Company; ' || d.text END AS cover FROM documents d JOIN part ON p_partkey = 1 + d.doc_id % 97"


@query(
    "T11_companies_on_cover",
    f"""SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN [] ELSE list_sort(list_distinct([{_PARTY.format(x="upper(substring(p_name, 1, 1)) || substring(p_name, 2, instr(p_name, ' ') - 2) || ' North'")}, 'BETA GAMMA', 'HOUSE CARDS', 'FOO & BAR DELTA'])) END AS names
    FROM documents JOIN part ON p_partkey = 1 + doc_id % 97""",
)
def _(t: Tables) -> DataFrame:
    """Names with small words, `&`, commas and several forms; words in lower case before a form are no name."""
    parts = t.part.select("p_partkey", "p_name")
    made = t.documents.select("doc_id").join(parts, F.col("p_partkey") == 1 + F.col("doc_id") % 97)
    first = F.concat(F.upper(F.substring("p_name", 1, 1)), F.expr("substring(p_name, 2, instr(p_name, ' ') - 2)"))
    cover = F.concat(F.lit("by and among "), first, F.lit(" North Corp., a delaware corporation, Beta  of the Gamma, L.L.C., House of Cards CORPORATION; Foo & Bar and Delta, INC (x)"))
    return made.select("doc_id", T.party_names(F.when(F.col("doc_id") % 5 == 0, "no names, a delaware corporation").otherwise(cover)).alias("names"))


_FIELDS = "[s_name || ' & Jones LLP; Firm ' || s_nationkey || ', P.C. ;', s_name || ' and Partners LLP', 'Alpha Beta LLP and ' || s_name || ' P.C.', s_name || chr(10) || chr(10) || 'Other / Third LLC', ' ; ', 'Gamma L.L.P. and Delta, Inc. (US)', ', LLP', 'One And Two, Ltd. (NY)'][s_suppkey % 8 + 1]"
_FORMS = "llp|l\\.l\\.p\\.|limited liability partnership|pc|p\\.c\\.|professional corporation|pllc|plc|llc|ltd|lp|l\\.p\\.|corp\\.?|corporation|inc\\.?|n\\.v\\.|a\\.p\\.c\\.|s\\.c\\."
#: SQL of a name as it is shown, and of its key, of the text in place of {x}; the loop of the rule three times, which is enough here.
_ONCE = rf"trim(regexp_replace(trim(regexp_replace({{x}}, '(?i)\s*\((?:us|u\.s\.|usa|ny|delaware|uk)\)\s*$', '')), '(?i)(?:(?:,|\s)+(?:{_FORMS}))+\.?\s*$', ''), ' ,;')"
_DISPLAY = "trim(regexp_replace(regexp_replace({y}, '(?i)\\s+and\\s+', ' & ', 'g'), '\\s+', ' ', 'g'))"
_KEY = "array_to_string(list_filter(string_split_regex(trim(replace(regexp_replace(replace(lower({x}), '&', ' and '), '[^a-z0-9 ]+', ' ', 'g'), ' and ', ' ')), ' +'), lambda w: w NOT IN ('llp', 'pc', 'professional', 'corporation', 'pllc', 'plc', 'llc', 'lp', 'corp', 'inc', 'ltd', 'nv', 'apc', 'sc', '')), ' ')"


def _shown(x: str) -> str:
    for _ in range(3):
        x = _ONCE.replace("{x}", x)
    return _DISPLAY.replace("{y}", x)


@query(
    "T12_counsel",
    rf"""SELECT s_suppkey, firms, list_transform(firms, lambda n: {_KEY.replace("{x}", _shown("n"))}) AS keys FROM (SELECT s_suppkey, list_filter(list_transform(string_split_regex(regexp_replace({_FIELDS},
    '(?i)(\b(?:llp|l\.l\.p\.|pc|p\.c\.|professional corporation|pllc|plc|llc|ltd|lp|l\.p\.|n\.v\.|a\.p\.c\.|corp\.|corporation)\b)\s+and\s+', '\1;', 'g'), '\s*;\s*|\s*\n+\s*|\s+/\s+'), lambda n: trim(n, ' ;,')), lambda n: n <> '') AS firms FROM supplier)""",
)
def _(t: Tables) -> DataFrame:
    firms = T.split_firms(fields())
    return t.supplier.select("s_suppkey", firms.alias("firms"), F.transform(firms, lambda n: T.counsel_key(T.firm_display(n))).alias("keys"))


def fields() -> F.Column:
    """Fields of one and of several firms."""
    f = F.concat
    said = (
        f("s_name", F.lit(" & Jones LLP; Firm "), "s_nationkey", F.lit(", P.C. ;")), f("s_name", F.lit(" and Partners LLP")), f(F.lit("Alpha Beta LLP and "), "s_name", F.lit(" P.C.")), f("s_name", F.lit("\n\nOther / Third LLC")),
        F.lit(" ; "), F.lit("Gamma L.L.P. and Delta, Inc. (US)"), F.lit(", LLP"), F.lit("One And Two, Ltd. (NY)"),
    )
    return F.element_at(F.array(*said), (F.col("s_suppkey") % 8 + 1).cast("int"))


@query(
    "T12_canonical",
    f"""WITH n AS (SELECT s_suppkey, {_shown("s_name || [' & Co LLP', ', P.C. (US)', ' AND Partners'][s_suppkey % 3 + 1]")} AS shown FROM supplier), k AS (SELECT s_suppkey, shown, {_KEY.replace("{x}", "shown")} AS key FROM n),
    a AS (SELECT s_name || ' & Partners' AS name, 'House ' || s_nationkey AS instead FROM supplier WHERE s_suppkey % 4 = 0 UNION ALL SELECT lower(s_name), 'Firm of ' || s_nationkey || ', LLC' FROM supplier WHERE s_suppkey % 2 = 0),
    e AS (SELECT name, min(instead) AS instead FROM a GROUP BY 1), f AS (SELECT {_KEY.replace("{x}", "name")} AS key, min(instead) AS instead FROM a GROUP BY 1)
    SELECT s_suppkey, {_KEY.replace("{x}", "coalesce(e.instead, f.instead, k.shown)")} AS firm_key FROM k LEFT JOIN e ON e.name = k.shown LEFT JOIN f ON f.key = k.key""",
)
def _(t: Tables) -> DataFrame:
    """Aliases by name and by key, taken from the suppliers themselves."""
    from folioforge.operators.counsel import canonical_names

    k = F.col("s_suppkey")
    names = t.supplier.select("s_suppkey", F.concat("s_name", F.element_at(F.array(F.lit(" & Co LLP"), F.lit(", P.C. (US)"), F.lit(" AND Partners")), (k % 3 + 1).cast("int"))).alias("name"))
    aliases = t.supplier.filter(k % 4 == 0).select(F.concat("s_name", F.lit(" & Partners")).alias("name"), F.concat(F.lit("House "), "s_nationkey").alias("instead"))
    aliases = aliases.unionByName(t.supplier.filter(k % 2 == 0).select(F.lower("s_name").alias("name"), F.concat(F.lit("Firm of "), "s_nationkey", F.lit(", LLC")).alias("instead")))
    return canonical_names(names, "name", aliases).select("s_suppkey", "firm_key")


@query(
    "T13_snippet",
    r"""
WITH a AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS x FROM documents),
b AS (SELECT doc_id, x, lower(x) AS low, length(x) AS n FROM a),
c AS (SELECT *, list_filter(['Que ', 'the', 'no such'], lambda w: contains(low, trim(lower(w)))) AS matched FROM b),
d AS (SELECT *, list_min(list_transform(matched, lambda w: instr(low, trim(lower(w))) - 1)) AS first FROM c),
e AS (SELECT *, greatest(first - 20, 0) AS s FROM d),
f AS (SELECT *, CASE WHEN least(s + 60, n) - s < 60 AND s > 0 THEN greatest(least(s + 60, n) - 60, 0) ELSE s END AS start, least(s + 60, n) AS stop FROM e)
SELECT doc_id, matched, CASE WHEN x = '' THEN '' WHEN first IS NULL THEN CASE WHEN n > length(rtrim(substring(x, 1, 60))) THEN rtrim(rtrim(substring(x, 1, 60)), ' .,;:') || '...' ELSE rtrim(substring(x, 1, 60)) END
  ELSE CASE WHEN stop < n THEN rtrim(CASE WHEN start > 0 THEN '...' ELSE '' END || trim(substring(x, start + 1, stop - start)), ' .,;:') || '...' ELSE CASE WHEN start > 0 THEN '...' ELSE '' END || trim(substring(x, start + 1, stop - start)) END END AS snip
FROM f
""",
)
def _(t: Tables) -> DataFrame:
    snippet, matched = T.focused_snippet(F.col("text"), ["Que ", "the", " ", "no such"], 60)
    return docs(t, snip=snippet, matched=matched)


@query(
    "T14_plain_snippet",
    r"""SELECT page_id, CASE WHEN x = '' THEN NULL WHEN length(x) <= 220 THEN x ELSE rtrim(substring(x, 1, 219)) || '…' END AS snip FROM (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS x FROM pages)""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.tag_snippet(F.col("html")).alias("snip"))


@query(
    "T15_amounts",
    r"""
WITH said AS (
  SELECT doc_id, text || ' $1,000,000, but $5mm, $ 2 bn and $5 TRILLION or ' || doc_id || ',5 Million dollars; $3,000,000 to $' || n_chars || '.50, $' || n_chars || '.50 by $1,000,000 t ' || CASE WHEN doc_id % 5 = 0
    THEN array_to_string(list_transform(range(20), lambda i: '$' || i || 'K'), ' ') ELSE '7 thousand, $x' END AS x FROM documents
), found AS (
  SELECT doc_id, unnest(v) AS v, unnest(range(len(v))) AS i
  FROM (SELECT doc_id, regexp_extract_all(x, '(?i)\$\s*\d(?:[\d,]*\d)?(?:\.\d+)?(?:\s*(?:billion|million|trillion|thousand|bn|mm|[BMTK])\b)?|\d(?:[\d,]*\d)?(?:\.\d+)?\s+(?:billion|million|trillion|thousand)\s+dollars?') AS v FROM said)
), once AS (SELECT doc_id, arg_min(v, i) AS v, min(i) AS i, row_number() OVER (PARTITION BY doc_id ORDER BY min(i)) AS r FROM found GROUP BY doc_id, lower(v))
SELECT doc_id, list(v ORDER BY i) FILTER (WHERE r <= 20) AS found, count(*) > 20 AS more FROM once GROUP BY doc_id
""",
)
def _(t: Tables) -> DataFrame:
    """Every fifth text has more sums than are kept."""
    many = F.when(F.col("doc_id") % 5 == 0, F.array_join(F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.concat(F.lit("$"), i, F.lit("K"))), " ")).otherwise("7 thousand, $x")
    parts = (" $1,000,000, but $5mm, $ 2 bn and $5 TRILLION or ", "doc_id", ",5 Million dollars; $3,000,000 to $", "n_chars", ".50, $", "n_chars", ".50 by $1,000,000 t ")
    said = F.concat("text", *[F.col(p) if p in ("doc_id", "n_chars") else F.lit(p) for p in parts], many)
    found, more = T.amounts(said)
    return docs(t, found=found, more=more)


_STATES = ("New York", "York", "West Virginia", "Virginia", "England and Wales", "Delaware")
_WHERE = ("laws of new york and VIRGINIA", "of West Virginia, Delaware; delaware", "Yorkshire, Delawares, Virginian", "York and England and Wales.", "none")
_WHERE_FOUND = (["New York", "Virginia"], ["Delaware", "West Virginia"], ["N/A"], ["England and Wales", "York"], ["N/A"])


@query("T16_mentions", "SELECT doc_id, [" + ", ".join(str(x) for x in _WHERE_FOUND) + "][doc_id % 5 + 1] AS states FROM documents")
def _(t: Tables) -> DataFrame:
    return docs(t, states=T.mentions(F.concat_ws(" ", chosen(_WHERE, "doc_id"), "text"), _STATES))


_FITS = "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN split_part(p_type, ' ', 1) WHEN 1 THEN p_brand ELSE '' END AS concept, p_type AS label, p_size / 50 AS score, p_partkey % 2 = 0 AS matched FROM part"


@query(
    "T18_confidence",
    f"""SELECT p_partkey, CASE WHEN c <> '' AND contains(l, c) THEN 'canonical' WHEN matched AND score >= 0.75 THEN 'proxy' ELSE 'broad_match' END AS fit, CASE WHEN score >= 0.85 THEN 'high' WHEN score >= 0.6 THEN 'medium' ELSE 'low' END AS confidence
    FROM (SELECT *, trim(regexp_replace(replace(lower(concept), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS c, trim(regexp_replace(replace(lower(label), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS l FROM ({_FITS}))""",
)
def _(t: Tables) -> DataFrame:
    k, score = F.col("p_partkey") % 3, F.col("p_size") / 50
    concept = F.when(k == 0, F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))).when(k == 1, F.col("p_brand")).otherwise("")
    fit = T.fit(T.concept_key(concept), T.concept_key(F.col("p_type")), score, F.col("p_partkey") % 2 == 0)
    return t.part.select("p_partkey", fit.alias("fit"), T.confidence(score).alias("confidence"))


@query("T19_numbers", "SELECT n, v, k FROM (VALUES ('XIV', 14, NULL), ('iv', 4, NULL), ('MCMXC', 1990, NULL), ('6.10', NULL, 6010.0::DOUBLE), ('6.10a', NULL, 6010.5), ('abc', NULL, NULL)) x(n, v, k)")
def _(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(x,) for x in ("XIV", "iv", "MCMXC", "6.10", "6.10a", "abc")], "n string")
    return rows.select("n", T.roman_value(F.col("n")).alias("v"), T.section_key(F.col("n")).alias("k"))


@query("T20_bm25_tokens", r"SELECT doc_id, len(list_filter(regexp_extract_all(regexp_replace(lower(text), '\[[^\]]*\]', ' ', 'g'), '[a-z0-9]+'), lambda x: length(x) > 1))::INT AS n FROM documents")
def _(t: Tables) -> DataFrame:
    return docs(t, n=F.size(T.bm25_tokens(F.col("text"))))


STOPS = ("the", "of", "and", "en", "in", "de", "la")
_STOPS = ", ".join(f"'{s}'" for s in STOPS)


@query(
    "T21_ngrams",
    f"""SELECT doc_id, (len(list_filter(range(1, len(w) - 1), lambda i: w[i] NOT IN ({_STOPS}) AND w[i + 2] NOT IN ({_STOPS}))) + len(list_filter(range(1, len(w) - 2), lambda i: w[i] NOT IN ({_STOPS}) AND w[i + 3] NOT IN ({_STOPS}))))::INT AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    return docs(t, n=T.ngram_count(F.col("text"), 3, 4, STOPS))


@query(
    "T21_ngram_texts",
    f"""SELECT g, count(*) AS n FROM (SELECT unnest(list_transform(list_filter(range(1, len(w) - 1), lambda i: w[i] NOT IN ({_STOPS}) AND w[i + 2] NOT IN ({_STOPS})), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM (SELECT regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)) GROUP BY 1 HAVING count(*) > 3""",
)
def _(t: Tables) -> DataFrame:
    grams = t.documents.select(F.explode(T.ngrams(F.col("text"), 3, 3, STOPS)).alias("g"))
    return grams.groupBy("g").agg(F.count("*").alias("n")).filter("n > 3")


@query("T23_reading_grade", r"SELECT doc_id, round(CASE WHEN w > 0 THEN 0.39::DOUBLE * w / s + 11.8::DOUBLE * greatest(w, v) / w - 15.59 END, 6) AS grade FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+')) AS w, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS v FROM documents)")
def _(t: Tables) -> DataFrame:
    return docs(t, grade=F.round(T.reading_grade(F.col("text")), 6))


@query("T24_taxonomy_search", "SELECT p_partkey FROM part WHERE contains(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]', '', 'g'), 'd1')")
def _(t: Tables) -> DataFrame:
    return t.part.filter(F.contains(T.plain_key(F.concat_ws(" ", "p_brand", "p_type")), F.lit("d1"))).select("p_partkey")


_OTHER = "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', 'https://www.') WHEN 2 THEN regexp_replace(url, '/[^/]*$', '/other.htm') WHEN 3 THEN 'https://host/root.htm' ELSE regexp_replace(url, '/[^/]*$', '/deep/x.htm') END"


@query(
    "T25_same_folder",
    rf"""SELECT page_id, f1 <> '' AND f1 = f2 AND h1 = h2 AS same FROM (SELECT page_id, regexp_extract(u, '^[a-z]+://([^/?#]+)((?:/[^/?#]+)+)/[^/?#]*(?:[?#].*)?$', 2) AS f1, regexp_extract(v, '^[a-z]+://([^/?#]+)((?:/[^/?#]+)+)/[^/?#]*(?:[?#].*)?$', 2) AS f2,
    regexp_extract(u, '^[a-z]+://([^/?#]+)', 1) AS h1, regexp_extract(v, '^[a-z]+://([^/?#]+)', 1) AS h2 FROM (SELECT page_id, url AS u, {_OTHER} AS v FROM pages))""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("page_id") % 5
    other = F.when(k == 0, F.col("url")).when(k == 1, F.regexp_replace("url", "^[a-z]+://", "https://www.")).when(k == 2, F.regexp_replace("url", "/[^/]*$", "/other.htm")).when(k == 3, "https://host/root.htm").otherwise(F.regexp_replace("url", "/[^/]*$", "/deep/x.htm"))
    return t.pages.select("page_id", T.same_folder(F.col("url"), other).alias("same"))


@query(
    "T27_page_features",
    r"""SELECT doc_id, length(text)::INT AS n_chars, len(regexp_extract_all(text, '\S+'))::INT AS n_words, round(len(regexp_extract_all(text, '[0-9]')) / greatest(1, length(text)), 8) AS digit_share, round(len(regexp_extract_all(text, '[A-Z]')) / greatest(1, length(text)), 8) AS upper_share,
    len(l)::INT AS n_lines, """ + ", ".join(f"round(CASE WHEN len(l) > 0 THEN len(list_filter(l, lambda x: {c})) / len(l) ELSE 0 END, 8) AS {n}" for n, c in (("short_lines", "length(x) < 40"), ("dotted_lines", r"regexp_matches(x, '\.{4,}|(\. ){3,}')"), ("number_end_lines", r"regexp_matches(x, '[0-9]+\s*$')"))) + r""",
    len(regexp_extract_all(text, '(?i)\bsection [0-9]+\.[0-9]+'))::INT AS n_section, len(regexp_extract_all(text, '(?i)\barticle [ivxlc0-9]+\b'))::INT AS n_article, len(regexp_extract_all(text, '(?m)^\s*By:'))::INT AS n_by, contains(lower(text), 'table of contents') AS has_toc, contains(lower(text), 'in witness whereof') AS has_witness
    FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM (SELECT doc_id, text || CASE doc_id % 4 WHEN 0 THEN chr(10) || 'Section 1.2 x .... 12' || chr(10) || 'Article IV' WHEN 1 THEN chr(10) || ' By: IN WITNESS WHEREOF' ELSE ' Table of Contents . . . 4' END AS text FROM documents))""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    made = F.concat("text", F.when(k == 0, "\nSection 1.2 x .... 12\nArticle IV").when(k == 1, "\n By: IN WITNESS WHEREOF").otherwise(" Table of Contents . . . 4"))
    f = T.page_features(F.col("made"))
    share = ("digit_share", "upper_share", "short_lines", "dotted_lines", "number_end_lines")
    return t.documents.select("doc_id", made.alias("made")).select("doc_id", *[(F.round(v, 8) if c in share else v).alias(c) for c, v in f.items()])


@query("T30_without_control", "SELECT doc_id, text AS plain FROM documents")
def _(t: Tables) -> DataFrame:
    return docs(t, plain=T.without_control(F.concat(F.lit("\u0001"), F.col("text"), F.lit("\u0008"))))


@query("D1_dated_as_of", "SELECT o_orderkey, CASE WHEN o_orderkey % 8 IN (3, 4, 5) THEN NULL ELSE o_orderdate::DATE END AS dated FROM orders")
def _(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 8, F.col("o_orderdate")
    later = F.date_format(F.date_add(d, 400), "' dated as of 'MMMM d, yyyy")
    said = (
        F.when(k == 0, F.concat(F.date_format(d, "'AGREEMENT dated as of 'MMMM d, yyyy' by'"), later)).when(k == 1, F.date_format(d, "'Dated: 'd MMMM yyyy")).when(k == 2, F.date_format(d, "'dated  as of\nthe 'd'th day of 'MMMM, yyyy"))
        .when(k == 3, "dated as of June 31, 2021").when(k == 4, F.date_format(d, "'updated as of 'MMMM d, yyyy")).when(k == 5, F.concat("o_orderstatus", F.lit(" no date"))).when(k == 6, F.concat(F.lit("dated as of June 31, 2021 "), F.date_format(d, "'dated 'MMMM d yyyy")))
        .otherwise(F.concat(F.col("o_orderpriority"), F.date_format(d, "' DATED AS OF 'MMMM d, yyyy")))
    )
    return t.orders.select("o_orderkey", T.dated_as_of(said).alias("dated"))


@query("D2_restated_dates", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN [o_orderdate::DATE] WHEN 1 THEN [o_orderdate::DATE, o_orderdate::DATE + 100] ELSE []::DATE[] END AS dates, o_orderkey % 5 = 4 AS title FROM orders")
def _(t: Tables) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    one, two = F.date_format(d, "'dated as of 'MMMM d, yyyy"), F.date_format(F.date_add(d, 100), "'dated 'd MMMM yyyy")
    far = F.repeat(F.lit("filler "), 80)
    said = (
        F.when(k == 0, F.concat(far, F.lit("amends and restates the original merger agreement, "), one, F.lit(" and "), one)).when(k == 1, F.concat(far, F.lit("was amended and restated by that agreement "), two, F.lit("; amends and restates the agreement "), one))
        .when(k == 2, F.concat(far, F.lit("amends and restates the agreement "), far, far, one)).when(k == 3, F.concat(far, F.lit("an agreement "), one)).otherwise(F.concat(F.lit("AMENDED AND\nRESTATED MERGER AGREEMENT "), far))
    )
    return t.orders.select("o_orderkey", T.restated_dates(said).alias("dates"), T.restates(said).alias("title"))


@query("D3_years_ago", "SELECT o_orderkey, (o_orderdate::DATE - INTERVAL 3 YEAR)::DATE AS before FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", T.years_ago(F.col("o_orderdate").cast("date"), 3).alias("before"))


@query("D4_truncated", "SELECT event_id, date_trunc('hour', ts) AS hour, date_trunc('day', ts)::TIMESTAMP AS day FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.date_trunc("hour", "ts").alias("hour"), F.date_trunc("day", "ts").alias("day"))


@query("D5_periods", "SELECT o_orderkey, (1990 + (year(o_orderdate) - 1990) // 5 * 5)::INT AS first_year FROM orders")
def _(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", (1990 + F.floor((F.year("o_orderdate") - 1990) / 5) * 5).cast("int").alias("first_year"))


@query("M3_min_max_scale", "SELECT s_suppkey, s_nationkey, round(CASE WHEN max(s_acctbal) OVER w > min(s_acctbal) OVER w THEN (s_acctbal - min(s_acctbal) OVER w) / (max(s_acctbal) OVER w - min(s_acctbal) OVER w) ELSE 0 END, 8) AS scaled FROM supplier WINDOW w AS (PARTITION BY s_nationkey)")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.retrieval import min_max

    return min_max(t.supplier, ["s_nationkey"], "s_acctbal", "scaled").select("s_suppkey", "s_nationkey", F.round("scaled", 8).alias("scaled"))


@query("M7_safe_integers", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, TRY_CAST(event_type AS BIGINT) AS none FROM events")
def _(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"), F.col("event_type").try_cast("long").alias("none"))


_PRICES = """SELECT o_orderkey, ['cash', 'stock', 'mixed', 'other', NULL][o_orderkey % 5 + 1] AS kind, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS cash, CASE WHEN o_orderkey % 3 = 0 THEN 5.5 WHEN o_orderkey % 3 = 1 THEN 0.0 END::DOUBLE AS stock,
    CASE WHEN o_orderstatus = 'F' THEN 0.25 END::DOUBLE AS assets FROM orders"""


@query(
    "M8_price_total",
    f"""SELECT o_orderkey, CASE WHEN kind = 'cash' THEN cash WHEN kind = 'stock' THEN stock WHEN (cash IS NOT NULL)::INT + (stock IS NOT NULL)::INT + (assets IS NOT NULL)::INT >= 2 THEN coalesce(cash, 0) + coalesce(stock, 0) + coalesce(assets, 0) END AS total,
    coalesce((kind = 'cash' AND (coalesce(stock, 0) > 0 OR coalesce(assets, 0) > 0)) OR (kind = 'stock' AND (coalesce(cash, 0) > 0 OR coalesce(assets, 0) > 0)), FALSE) AS conflict FROM ({_PRICES})""",
)
def _(t: Tables) -> DataFrame:
    from folioforge.operators.states import price_conflict, price_total

    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("cash", "stock", "mixed", "other")], F.lit(None).cast("string")), (k % 5 + 1).cast("int"))
    parts = (F.when(k % 2 == 0, F.col("o_totalprice")), F.when(k % 3 == 0, 5.5).when(k % 3 == 1, 0.0), F.when(F.col("o_orderstatus") == "F", 0.25))
    return t.orders.select("o_orderkey", price_total(kind, *parts).alias("total"), price_conflict(kind, *parts).alias("conflict"))


@query("M9_latency_slots", "SELECT event_id, CASE WHEN value <= 25 THEN 0 WHEN value <= 50 THEN 1 WHEN value <= 100 THEN 2 WHEN value <= 250 THEN 3 WHEN value <= 500 THEN 4 WHEN value <= 1000 THEN 5 WHEN value <= 2000 THEN 6 WHEN value <= 5000 THEN 7 WHEN value <= 10000 THEN 8 ELSE 9 END AS slot FROM events")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.rollups import bucket_slot

    return t.events.select("event_id", bucket_slot(F.col("value")).alias("slot"))


@query("M10_terciles", "SELECT c_custkey, ntile(3) OVER (ORDER BY c_acctbal, c_custkey)::INT AS tercile FROM customer")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.rollups import ntiles

    return ntiles(t.customer.select("c_custkey", "c_acctbal"), "c_acctbal", [F.asc("c_acctbal"), F.asc("c_custkey")], 3, "tercile").drop("c_acctbal")


@query("M10_fixed_edges", "SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 1000 THEN 'low' WHEN c_acctbal > 1000 AND c_acctbal <= 5000 THEN 'middle' WHEN c_acctbal > 5000 AND c_acctbal <= 9000 THEN 'high' END AS bucket FROM customer")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.rollups import cut_edges

    return t.customer.select("c_custkey", cut_edges(F.col("c_acctbal"), [0, 1000, 5000, 9000], ["low", "middle", "high"]).alias("bucket"))


@query("M2_linear_quantile", "SELECT c_nationkey, round(quantile_cont(c_acctbal, 0.1) FILTER (WHERE c_acctbal > 0), 6) AS p10, round(quantile_cont(c_acctbal, 0.95) FILTER (WHERE c_acctbal > 0), 6) AS p95 FROM customer GROUP BY 1")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.rollups import quantiles

    return quantiles(t.customer, ["c_nationkey"], "c_acctbal", {"p10": 0.1, "p95": 0.95}).withColumns({c: F.round(c, 6) for c in ("p10", "p95")})


@query("R1_merged_spans", "WITH s AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::INT AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s), g AS (SELECT *, sum(CASE WHEN p IS NULL OR a > p + 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS i FROM m) SELECT k, min(a) AS start, max(b) AS stop FROM g GROUP BY k, i")
def _(t: Tables) -> DataFrame:
    from folioforge.functions.spans import merge_spans

    spans = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.rint("l_quantity").cast("int")).alias("stop"))
    return merge_spans(spans, "k", gap=3)


@query("R4_distinct_in_order", "SELECT conv_id, list(role ORDER BY t, role) AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables) -> DataFrame:
    # of each conversation only its different roles are gathered, not its turns
    first = t.conversations.groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    return first.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "role"))), lambda x: x["role"]).alias("roles"))


_LISTS = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN '["' || p_brand || '", "' || p_type || '"]' WHEN 1 THEN '[]' WHEN 2 THEN '' WHEN 3 THEN '["' || p_brand WHEN 4 THEN '{"a": 1}' ELSE NULL END AS said FROM part"""


@query("N1_json_lists", f"SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN [p_brand, p_type] WHEN p_partkey % 6 = 1 THEN []::VARCHAR[] END AS strict, CASE WHEN p_partkey % 6 = 0 THEN [p_brand, p_type] ELSE []::VARCHAR[] END AS lenient FROM ({_LISTS}) JOIN part USING (p_partkey)")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", json_said().alias("said")).select("p_partkey", T.json_list(F.col("said")).alias("strict"), T.json_list(F.col("said"), strict=False).alias("lenient"))


def json_said():
    k = F.col("p_partkey") % 6
    return F.when(k == 0, F.concat(F.lit('["'), "p_brand", F.lit('", "'), "p_type", F.lit('"]'))).when(k == 1, "[]").when(k == 2, "").when(k == 3, F.concat(F.lit('["'), "p_brand")).when(k == 4, '{"a": 1}')


@query("N2_compact_json", """SELECT p_partkey, '["' || p_brand || '","' || p_type || '"]' AS j FROM part""")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.to_json(F.array("p_brand", "p_type")).alias("j"))


@query("N3_bridge", "SELECT p_partkey, unnest([p_brand, p_type]) AS id FROM part WHERE p_partkey % 6 = 0")
def _(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.explode(T.json_list(json_said(), strict=False)).alias("id"))


@query("N4_response_check", "SELECT event_id, CASE WHEN k IS NULL THEN 'unparsed' WHEN k >= 50 THEN 'unknown' ELSE 'ok' END AS verdict FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)")
def _(t: Tables) -> DataFrame:
    k = F.from_json("props", "k int")["k"]
    return t.events.select("event_id", F.when(k.isNull(), "unparsed").when(k >= 50, "unknown").otherwise("ok").alias("verdict"))


@query(
    "N5_violations",
    "SELECT o_orderkey, list_filter([CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'bad_enum' END, CASE WHEN o_totalprice < 10000 THEN 'too_small' END, CASE WHEN year(o_orderdate) > 1997 THEN 'late' END], lambda x: x IS NOT NULL) AS codes FROM orders",
)
def _(t: Tables) -> DataFrame:
    from folioforge.operators.states import violations

    rules = {"bad_enum": ~F.col("o_orderstatus").isin("F", "O"), "too_small": F.col("o_totalprice") < 10_000, "late": F.year("o_orderdate") > 1997}
    return t.orders.select("o_orderkey", violations(rules).alias("codes"))


@query("N6_tree", "SELECT r_name, list_sort(list(n_name)) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))


@query(
    "U6_uuid5",
    """SELECT page_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INT % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid
    FROM (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)""",
)
def _(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.uuid5("6ba7b8119dad11d180b400c04fd430c8", F.col("url")).alias("uuid"))


@query(
    "T5_quick_links",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || 'QuickLinks' WHEN 1 THEN chr(10) || 'QuickLinks' || chr(10) || '-- Click here to rapidly navigate through this document' || chr(10) || text WHEN 2 THEN 'QuickLinks' ELSE text END AS moved FROM documents""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 4
    said = F.when(k == 0, F.concat(F.lit("\n QuickLinks \n"), "text")).when(k == 1, F.concat(F.lit("\nQuickLinks\n-- Click here to rapidly navigate through this document\n"), "text")).when(k == 2, "QuickLinks").otherwise(F.col("text"))
    return docs(t, moved=T.quick_links_last(said))


@query(
    "T5_chrome",
    r"""SELECT doc_id, trim(CASE WHEN doc_id % 3 = 0 THEN regexp_replace('One' || chr(10) || text, '\n{3,}', chr(10) || chr(10), 'g') WHEN doc_id % 3 = 1 THEN regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g') ELSE text END, ' ' || chr(9) || chr(10) || chr(13)) AS plain FROM documents""",
)
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 3
    said = F.when(k == 0, F.concat(F.lit("QuickLinks\n-- click here to rapidly navigate through this document\nOne\n  Back to Contents\n"), "text")).when(k == 1, F.concat(F.lit("\nReturn to the Table of Contents\n"), "text")).otherwise(F.col("text"))
    return docs(t, plain=T.without_chrome(said))


_COURT = "CASE doc_id % 5 WHEN 0 THEN 'In the Court of Chancery of the State of Delaware, ' WHEN 1 THEN 'U.S. District Court for the District of Delaware: ' WHEN 2 THEN 'the Delaware court of chancery/' WHEN 3 THEN 'the 12-34 federal district court for the district of Delaware ' ELSE '' END"


@query(
    "T22_phrase_text",
    rf"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(x, '[-/]+', ' ', 'g'), '[^a-z0-9\s'']+', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'in delaware court of chancery, ' WHEN 1 THEN 'district of delaware: ' WHEN 2 THEN 'delaware court of chancery/' WHEN 3 THEN 'the 12-34 district of delaware ' ELSE '' END || lower(text) AS x FROM documents)""",
)
def _(t: Tables) -> DataFrame:
    return docs(t, plain=T.phrase_text(F.concat(F.expr(_COURT), F.col("text"))))


@query(
    "T22_noisy_phrases",
    """SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN TRUE WHEN 1 THEN TRUE WHEN 2 THEN FALSE WHEN 3 THEN TRUE WHEN 4 THEN FALSE WHEN 5 THEN TRUE ELSE FALSE END AS noisy FROM part""",
)
def _(t: Tables) -> DataFrame:
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    phrase = (
        F.when(k == 0, F.concat(n, F.lit(" "), n)).when(k == 1, F.concat(F.lit("section "), n, F.lit(" a"))).when(k == 2, F.concat(n, F.lit(" days"))).when(k == 3, F.concat(n, F.lit(" 2nd day")))
        .when(k == 4, F.regexp_replace(F.lower("p_type"), "[^a-z ]", " ")).when(k == 5, F.lit(" ")).otherwise(F.concat(n, F.lit(" business days before")))
    )
    return t.part.select("p_partkey", T.noisy_phrase(phrase).alias("noisy"))


@query(
    "T23_complexity",
    r"""
WITH a AS (
  SELECT doc_id, len(regexp_extract_all(text, '\S+')) AS words, len(regexp_extract_all(text, '[A-Za-z]+')) AS w, greatest(1, len(regexp_extract_all(text, '[.!?]+'))) AS s, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS v, lang = 'en' AS several FROM documents
), b AS (SELECT doc_id, words, ln(1 + words) AS lw, CASE WHEN w > 0 THEN 0.39::DOUBLE * w / s + 11.8::DOUBLE * greatest(w, v) / w - 15.59 END AS g, several::INT AS several FROM a),
c AS (SELECT *, CASE WHEN max(lw) OVER () > min(lw) OVER () THEN (lw - min(lw) OVER ()) / (max(lw) OVER () - min(lw) OVER ()) ELSE 0 END AS x, CASE WHEN g IS NULL THEN NULL WHEN max(g) OVER () > min(g) OVER () THEN (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) ELSE 0 END AS y FROM b)
SELECT doc_id, words::INT AS words, round(g, 6) AS grade, round((x + coalesce(y, 0) + several) / (CASE WHEN y IS NULL THEN 2 ELSE 3 END), 6) AS complexity FROM c
""",
)
def _(t: Tables) -> DataFrame:
    from folioforge.operators.rollups import mean_complexity

    rows = docs(t, **T.complexity(F.col("text"), F.col("lang") == "en"))
    return mean_complexity(rows).select("doc_id", "words", F.round("grade", 6).alias("grade"), F.round("complexity", 6).alias("complexity"))


@query("T17_concepts")
def _(t: Tables) -> DataFrame:
    from folioforge.operators.concepts import matched_concepts

    labels = t.part.select(F.col("p_type").alias("id"), F.col("p_type").alias("label"), F.array("p_type", F.concat_ws(" > ", F.split_part(F.col("p_type"), F.lit(" "), F.lit(1)), "p_type")).alias("terms")).distinct()
    concepts = t.nation.select(F.col("n_nationkey").alias("concept_id"), F.concat_ws(" ", F.element_at(F.array(F.lit("steel"), F.lit("plated nickel"), F.lit("small & brushed")), (F.col("n_nationkey") % 3 + 1).cast("int")), "n_name").alias("concept"))
    return matched_concepts(concepts, labels, 5)


@query(
    "R2_aligned_quotes",
    """SELECT doc_id, CASE WHEN substring(text, e + 1, 12) = q THEN e WHEN instr(w, q) > 0 AND instr(substring(w, instr(w, q) + 1), q) = 0 THEN greatest(0, e - 128) + instr(w, q) - 1 END AS start FROM (SELECT *, substring(text, greatest(0, e - 128) + 1, e + 140 - greatest(0, e - 128)) AS w FROM (SELECT doc_id, text, substring(text, 31, 12) AS q, 30 + 7 * (doc_id % 2) AS e FROM documents WHERE length(text) > 60))
    WHERE substring(text, e + 1, 12) = q OR instr(w, q) > 0""",
)
def _(t: Tables) -> DataFrame:
    from folioforge.functions.spans import aligned

    rows = t.documents.filter(F.length("text") > 60).select("doc_id", "text", F.substring("text", 31, 12).alias("quote"), (30 + 7 * (F.col("doc_id") % 2)).alias("expected"))
    return rows.select("doc_id", aligned("text", "quote", "expected")["start"].alias("start"))


@query("R3_inserted_tags", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '<a>' || substring(text, 1, 5) || '</a>' || substring(text, 6, 2) || '<b>' || substring(text, 8, 5) || '</b>' || substring(text, 13) END AS tagged FROM documents WHERE length(text) >= 20")
def _(t: Tables) -> DataFrame:
    from folioforge.functions.spans import tagged

    second = F.when(F.col("doc_id") % 3 == 0, 3).otherwise(7)
    spans = F.array(F.struct(second.alias("start"), F.lit(12).alias("stop"), F.lit("b").alias("tag")), F.struct(F.lit(0).alias("start"), F.lit(5).alias("stop"), F.lit("a").alias("tag")))
    return t.documents.filter(F.length("text") >= 20).select("doc_id", tagged(F.col("text"), spans).alias("tagged"))
