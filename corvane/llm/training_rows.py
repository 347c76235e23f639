"""Which labelled rows a model may learn from, and bounded samples of them."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 3
HELD_OUT = 1


def held_out(id_col: Column | str = "doc_id") -> Column:
    """True for rows whose crc32 of the id as text leaves HELD_OUT modulo FOLDS; false for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def sample_ids(rows: DataFrame, class_col: str, per_class: int, id_col: str = "doc_id") -> list:
    """(class, id) of at most ``per_class`` rows of each class, spread over the table by a hash of the id.

    One aggregate finds the least hash in each of ``per_class`` buckets of a class, so that no
    group is ever gathered; the result is bounded by classes x per_class.
    """
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    keyed = rows.select(F.col(class_col).alias("c"), F.col(id_col).alias("i"), F.pmod(h, F.lit(per_class)).alias("b"), F.xxhash64(h, F.lit(7)).alias("h"))
    least = keyed.groupBy("c", "b").agg(F.min_by("i", "h").alias("i"))
    return sorted((r["c"], r["i"]) for r in least.collect())


def sample_texts(rows: DataFrame, class_col: str, per_class: int, longest: int, id_col: str = "doc_id", text_col: str = "text", texts: DataFrame | None = None) -> list[tuple]:
    """(class, id, whole text) of the sampled rows, in the order of class and a hash of the id, without empty texts and those of over ``longest`` bytes.

    At most classes x per_class x longest bytes reach the driver. Of several rows with one
    class and id the least text is taken. If the class comes from another table, ``rows`` is the join and ``texts``
    the table with id and text: the join then moves ids only, and the texts are read from ``texts``.
    """
    usable = rows.where(F.col(class_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull() & (F.octet_length(text_col).between(1, longest)))
    chosen = sample_ids(usable, class_col, per_class, id_col)
    if not chosen:
        return []
    kind = usable.schema
    wanted = rows.sparkSession.createDataFrame(chosen, f"`{class_col}` {kind[class_col].dataType.simpleString()}, `{id_col}` {kind[id_col].dataType.simpleString()}")
    if texts is None:
        own = usable.select(class_col, id_col, text_col).join(F.broadcast(wanted), [class_col, id_col])
    else:
        own = texts.where(F.octet_length(text_col).between(1, longest)).select(id_col, text_col).join(F.broadcast(wanted), id_col)
    found = own.select(class_col, id_col, text_col).dropDuplicates().collect()
    by_id: dict[tuple, str] = {}
    for c, i, text in found:
        by_id[c, i] = min(text, by_id.get((c, i), text))
    return [(c, i, by_id[c, i]) for c, i in sorted(by_id, key=lambda x: (x[0], xxhash.xxh3_64_intdigest(str(x[1])), x[1]))]
