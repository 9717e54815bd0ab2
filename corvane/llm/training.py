"""Bounded labelled samples for the models that are trained here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A row is held out of all training where crc32 of the id's text leaves remainder 0 by this.
HELD_OUT = 5


def held_out(id_col):
    """A null id counts as an empty one, which has remainder 0: it has no label to learn from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % HELD_OUT == 0


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `most` labelled documents (id, text, label), those of the lowest hash of the id, none of them held out.

    Rows without id or label are left out; an id that is labelled twice keeps its lowest label. Of
    documents that repeat an id one is taken, that of the lowest hash of the text (null first). The
    sampled ids are broadcast: `most` bounds them, and the rows.
    """
    slim = labels.select(F.col(id_col).alias("__key"), F.col(label).cast("int").alias("label")).where(F.col("__key").isNotNull() & F.col("label").isNotNull() & ~held_out("__key"))
    slim = slim.groupBy("__key").agg(F.min("label").alias("label")).orderBy(F.xxhash64(F.col("__key").cast("string")), "__key").limit(most)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(slim), F.col("id") == F.col("__key")).drop("__key")
    lowest = F.struct(F.when(F.col("text").isNull(), F.lit(None)).otherwise(F.xxhash64("text")).alias("mark"), "text")
    return rows.groupBy("id", "label").agg(F.min(lowest).alias("own")).select("id", "own.text", "label")
