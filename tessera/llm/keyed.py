"""Row keys and text-side joins shared by operators that change texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of columns selected from an input; ``free`` gives names to what is added beside an input's own columns.
ID, TEXT, KEY = "__id", "__text", "__key"


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, text, key): equal keys mean equal id and, but for a 2**-64 chance, equal text."""
    return docs.select(
        F.col(doc_id).cast("long").alias(ID),
        F.coalesce(F.col(text), F.lit("")).alias(TEXT),
    ).withColumn(KEY, F.xxhash64(ID, TEXT))


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """The key that ``keyed`` gives a row."""
    return F.xxhash64(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))


def matched(docs: DataFrame, keys: DataFrame, how: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose key is ("left_semi") or is not ("left_anti") among ``keys``."""
    (key,) = free(docs, KEY)
    wanted = keys.select(F.col(KEY).alias(key)).distinct()
    return docs.withColumn(key, key_of(doc_id, text)).join(wanted.hint("shuffle_hash"), key, how).drop(key)


def with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Left join on the key; the small side is the hash table, so texts are never sorted."""
    return docs.join(lists.hint("shuffle_hash"), KEY, "left")


