"""Bounded labelled samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def least(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """At most `rows` rows, those with the least hash of their keys; ties by the keys themselves.

    The rows are counted first and a threshold on the hash, with room to spare, keeps what the
    partitions hand to the final sort near `rows` in total, however many partitions there are.
    """
    scale = 1 << 40
    total = df.count()
    place = F.pmod(F.xxhash64(*keys), F.lit(scale))
    if total > rows:
        df = df.where(place < int(scale * min(1.0, (1.2 * rows + 1000) / total)))
    return df.orderBy(place, *keys).limit(rows)


def sample(docs: DataFrame, labels: DataFrame, label: str, mod: int, held_out: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, body) of at most `rows` labelled documents outside the held-out fold.

    The rows are those with the least hash of doc_id, so the choice does not depend on
    partitioning. A label given twice counts once (the greater one); null labels are left out.
    The sample's ids are broadcast: their number is bounded by `rows`.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (C.fold_of(id_col, mod) != held_out))
        .groupBy(F.col(id_col).cast("long").alias("_id"))
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    known = least(known, rows, "_id")
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), C.text_bytes(text_col).alias("body"))
    return texts.join(F.broadcast(known), "_id").select("y", "body")
