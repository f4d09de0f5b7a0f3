"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import strings, trimmed
from folioforge.llm.encoding import proven, token_counter


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every text, one row for each row of docs.

    A null text counts as empty: 0 bytes, 0 tokens, not over the limit. Repeated rows and null ids stay as they are; other
    columns are not read. Narrow: no shuffle, and a worker holds one Arrow batch and a bounded memo. The driver proves once which
    strings are one token; the set, no larger than the vocabulary, is broadcast.
    """
    whole = docs.sparkSession.sparkContext.broadcast(proven(tokenizer_path))

    @trimmed
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(tokenizer_path, whole.value)
        for batch in batches:
            counts = pa.array(counter.count(strings(batch.column("text"))), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
