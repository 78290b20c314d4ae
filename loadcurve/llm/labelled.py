"""Labelled rows for fitting, and whole texts scored in Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches


def id_remainder(mod: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text modulo ``mod`` (null for a null id)."""
    return F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % mod


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int) -> DataFrame:
    """(doc_id, text, n_chars, label) of at most ``most`` labelled ids, chosen by the hash of the id.

    ``usable`` says which ids may be learned from.  An id that is marked more
    than once takes the more frequent mark (a draw counts as 1); null marks and
    ids are passed over.  The chosen ids are few by ``most``, so they are
    broadcast to the documents.
    """
    bound_batches(docs.sparkSession)
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
             .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & usable)
             .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("int").alias("label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       n_chars.alias("n_chars"))
    return rows.join(F.broadcast(marks), "doc_id")


def with_scores(docs: DataFrame, inputs: dict[str, Column], score, names: dict[str, str]) -> DataFrame:
    """``docs`` with the columns that ``score(*input arrays) -> arrays`` gives.

    ``inputs`` are made as extra columns under reserved names and go again.  A
    column of ``docs`` that has the name of a result gives way to it.
    """
    bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in names]
    frame = docs.select(*[docs[f"`{f.name}`"] for f in kept],
                        *[c.alias(f"__{k}__") for k, c in inputs.items()])
    schema = T.StructType(kept + [T.StructField(k, T._parse_datatype_string(v)) for k, v in names.items()])
    n = len(kept)

    def run(batches):
        for batch in batches:
            made = score(*batch.columns[n:])
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *made], [f.name for f in kept] + list(names))

    return frame.mapInArrow(run, schema)
