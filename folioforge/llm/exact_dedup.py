"""Exact dedup by deterministic block naming, in DataFrame operations alone.

Texts are cut into blocks of BLOCK characters. Equal blocks get one integer name, different blocks different names; then each
two adjacent names of a document form a pair and the pairs are named alike, until every document has one name. No name comes
from a hash, so documents of different ids and texts never share one; only rows of one id are first merged by the SHA-256 of
their texts. Names depend on the rows alone, not on partitions or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm.common import ascii_lower, cut, lookup, packed, quoted

#: Characters of a block. At most HOT_SHARE hot blocks are broadcast: 32 MB if all their characters take 4 bytes.
BLOCK = 8192
#: Ranks are taken within so many buckets, to rank in parallel.
BUCKETS = 1 << 12


def normalised() -> Column:
    return ascii_lower(F.coalesce(F.col("text"), F.lit("")))


def row_key() -> Column:
    """Stands for a row by id and text: rows share it if both are equal (texts after lower-casing A-Z)."""
    return F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), F.sha2(normalised(), 256)), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text in lower case, its SHA-256, and `key`, which stands for a document: rows share it if id and text are equal."""
    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised().alias("norm"), row_key().alias("key"))
    return few.withColumn("text_sha256", F.sha2("norm", 256))


def keep_rows(docs: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows of docs whose row_key is in stays (key), all columns; of rows that repeat id and text the least by its text as it
    stands and the JSON of its other columns. Such rows collapse before they are shuffled, so a row repeated very often is one a task."""
    others = [quoted(c) for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select(packed(docs), row_key().alias("key"), F.struct(F.col("text"), rest.alias("rest")).alias("tie"))
    once = rows.groupBy("key").agg(F.min_by("row", "tie").alias("row"))
    return once.join(stays.select("key"), "key", "left_semi").select("row.*")


def ranked(distinct: DataFrame, columns: list[str]) -> DataFrame:
    """`name`: for each row, whose columns are distinct, an integer of its own: its rank within its bucket, and the bucket."""
    bucket = F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(*columns)).cast("long")
    return distinct.withColumn("_bucket", bucket).withColumn("name", (rank - 1) * BUCKETS + F.col("_bucket")).drop("_bucket")


def name_blocks(docs: DataFrame, total: int) -> DataFrame:
    """key, n, pos, name: of each distinct document its n blocks in order. Sorting the blocks meets equal ones; no block's text is kept."""
    blocks = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    cut_up = keyed(docs).select("key", blocks.alias("blocks")).select("key", F.greatest(F.size("blocks"), F.lit(1)).alias("n"), F.posexplode_outer("blocks").alias("pos", "block"))
    rows = cut_up.select("key", "n", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("block", F.lit("")).alias("block"))
    distinct = rows.groupBy("block").agg(F.min(F.struct("key", "pos")).alias("first"), F.count(F.lit(1)).alias("_n"))
    placed = cut(lookup(rows, distinct, ["block"], "_n", total).select("key", "n", "pos", F.col("first.key").alias("k"), F.col("first.pos").alias("p"), "_n").distinct())
    names = ranked(placed.groupBy("k", "p").agg(F.count(F.lit(1)).alias("_m")), ["k", "p"])
    return cut(lookup(placed, names, ["k", "p"], "_m", total).select("key", "n", "pos", "name"))


def name_pairs(rows: DataFrame, total: int) -> DataFrame:
    """key, n, pos, name one level up."""
    half = F.shiftright("pos", 1)
    side = lambda k: F.coalesce(F.max(F.when(F.col("pos") % 2 == k, F.col("name"))), F.lit(-1)).alias("right" if k else "left")
    pairs = rows.groupBy("key", F.shiftright(F.col("n") + 1, 1).alias("n"), half.alias("pos")).agg(side(0), side(1))
    names = ranked(pairs.groupBy("left", "right").agg(F.count(F.lit(1)).alias("_n")), ["left", "right"])
    return cut(lookup(pairs, names, ["left", "right"], "_n", total).select("key", "n", "pos", "name"))


def identities(docs: DataFrame) -> DataFrame:
    """key, identity (long): one row for each distinct (doc_id, normalised text); equal identities for equal texts, and only then."""
    size = F.greatest(F.ceil(F.coalesce(F.char_length("text"), F.lit(0)) / BLOCK), F.lit(1))
    most, total = docs.agg(F.max(size), F.sum(size)).first()
    most, total = int(most or 1), int(total or 0)
    rows, level, done = name_blocks(docs, total), 0, None
    while True:
        ended = rows.filter(F.col("n") == 1).select("key", (F.col("name") * 64 + level).alias("identity"))
        done = ended if done is None else done.unionByName(ended)
        if most == 1:
            return done
        rows, level, most, total = name_pairs(rows.filter(F.col("n") > 1), total), level + 1, (most + 1) // 2, total // 2 + 1


def groups(docs: DataFrame) -> DataFrame:
    """One row for each distinct (doc_id, normalised text): key, doc_id, text_sha256, copies (rows), keep_id, group_size."""
    rows = keyed(docs).groupBy("key", "doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("copies")).join(identities(docs), "key")
    rows = cut(rows)
    of = rows.groupBy("identity").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count(F.lit(1)).alias("_n"))
    return lookup(rows, of, ["identity"], "_n", rows.count()).drop("_n", "identity")


def find_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256, one row for each row of docs.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. The row with the largest doc_id of equal
    texts stays; of rows that repeat id and text one stays; a null doc_id stays only if all its group's ids are null. An empty
    table gives no rows; other columns are not read.
    """
    rows = groups(docs).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)
    return rows.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: of equal texts the one with the largest doc_id, of repeated rows one (see keep_rows)."""
    return keep_rows(docs, groups(docs).filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))))


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
 row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
"""
