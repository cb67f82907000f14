"""Licence notices in files, by a positional index of rare tokens.

Templates are short notices.  Their words, but for ``COMMON`` ones, form the
index: each word has postings (template, position).  The inverse document
frequency of every index word is counted over all files.  Of each template the
``RARE`` index words of its key phrase with the highest frequency weight are
looked up in every file; each occurrence and posting give a place where the
template would begin, and the words that agree on a place are intersected.  A
placement supported by all the looked-up words of the template is verified by
its mandatory key phrase standing where it must.  As those words are the key
phrase's own, every place where a key phrase stands is found, whatever else the
file holds.

Base labels come from fixed phrases, counted wherever their words stand
consecutively.  Everything is DataFrame functions.

Defined cases: null texts are empty; overlapping and repeated places all
count; ties of frequency are broken by the word; repeated rows are judged each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.keyed import ID, KEY
from tessera.llm.native import let
from tessera.llm.workspace import stage

#: What separates words, lower-case letters assumed or not.
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: (notice, mandatory key phrase); words as the separator above leaves them.
TEMPLATES = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "gnu affero general public license version 3"),
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "cc0-1.0": ("creative commons zero cc0 1 0 universal", "cc0 1 0 universal"),
    "gpl-2.0": ("licensed under the gnu general public license version 2", "gnu general public license version 2"),
    "gpl-3.0": ("licensed under the gnu general public license version 3", "gnu general public license version 3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3"),
    "mit": ("permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    "mit-name": ("licensed under the mit license", "the mit license"),
    "mpl-2.0": ("subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    "proprietary": ("copyright all rights reserved", "all rights reserved"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "unencumbered software released into the public domain"),
}
#: Words of notices that ordinary prose is full of: never index words.
COMMON = set("0 1 2 3 4 a all and any are by copy for free in into is of or person that the this to use with".split())
RARE = 4


def _phrase(text: str) -> list[str]:
    return text.split()


def index_words() -> list[str]:
    """Every word by which a file can be found."""
    return sorted({w for notice, key in TEMPLATES.values() for w in _phrase(notice) if w not in COMMON} | {"cc", "public", "rights"})


def _key_place(notice: str, key: str) -> int:
    """Position of the key phrase among the notice's words."""
    return len(_phrase(notice[: notice.index(key)]))


def rarest(label: str, rank: Callable[[str], int], rare: int = RARE) -> list[tuple[str, int]]:
    """(word, position in the notice) of the ``rare`` lowest ranked index words of a template's key phrase."""
    notice, key = TEMPLATES[label]
    place, words = _key_place(notice, key), set(index_words())
    own = [(w, place + i) for i, w in enumerate(_phrase(key)) if w in words]
    kept = sorted({w for w, _ in own}, key=rank)[:rare]
    return [(w, i) for w, i in own if w in kept]


def _starts(words: Column, phrase: list[str]) -> Column:
    """Places where the words of a phrase stand consecutively."""

    def here(w: Column, i: Column) -> Column:
        hit = w == phrase[0]
        for k, other in enumerate(phrase[1:], 1):
            hit = hit & F.coalesce(F.get(words, i + k) == other, F.lit(False))
        return F.when(hit, i)

    return F.filter(F.transform(words, here), lambda i: i.isNotNull())


def licences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rare: int = RARE) -> DataFrame:
    """(id, key, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    # Of all characters only two beyond ASCII have a lower case within it, or one that begins with it.
    odd = F.col("t").contains("K") | F.col("t").contains("İ")
    index = F.array(*map(F.lit, index_words()))
    rows = docs.select(F.col(doc_id).cast("long").alias(ID), F.xxhash64(F.col(doc_id).cast("long"), body).alias(KEY), body.alias("t"))
    lowered = F.when(odd, F.translate("t", UPPER, LOWER)).otherwise(F.lower("t"))
    found = let(F.filter(F.split(lowered, _GAP), lambda w: w != ""), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.when(F.arrays_overlap(w, index), w).alias("words")))
    split = rows.select(ID, KEY, found.alias("f")).select(ID, KEY, F.col("f.n").alias("n_words"), F.col("f.words").alias("words"))

    words = F.col("words")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(F.array_position(index, w).cast("int").alias("w"), i.alias("i"))), lambda h: h["w"] > 0)
    places = F.struct(*[_starts(words, _phrase(p)).alias(label.replace("-", "_")) for p, label in BASE.items()])
    kept = stage(split.select("*", F.when(words.isNotNull(), hits).alias("hits"), F.when(words.isNotNull(), places).alias("places")), "licence_words")

    some = kept.filter("words is not null")
    counts = some.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w")).groupBy("w").count().collect()  # a row for each index word
    seen = {r["w"]: r["count"] for r in counts}
    names = index_words()
    # inverse document frequency of each index word, by number; ties are broken by the word
    order = sorted(range(1, len(names) + 1), key=lambda k: (seen.get(k, 0), names[k - 1]))
    rank = {k: i for i, k in enumerate(order)}
    titles = sorted(TEMPLATES)
    keyed = [rarest(name, lambda w: rank[names.index(w) + 1], rare) for name in titles]
    of_word = {n: [] for n in names}
    for t, words_at in enumerate(keyed):
        for w, i in words_at:
            of_word[w].append((t, i))
    posting = F.array(*[F.array(*[F.struct(F.lit(n).alias("template"), F.lit(i).alias("at")) for n, i in of_word[w]]) if of_word[w] else F.array().cast("array<struct<template:int,at:int>>") for w in names])

    spots = F.explode(F.flatten(F.transform("hits", lambda h: F.transform(F.get(posting, h["w"] - 1), lambda p: F.struct(h["w"].alias("w"), p["template"].alias("template"), (h["i"] - p["at"]).alias("at"))))))
    spread = some.select(KEY, "words", spots.alias("s")).select(KEY, "words", "s.*")
    # the mandatory key phrase, where the placement says
    strings = lambda words: F.array(*map(F.lit, words))
    templates = []
    for (notice, key), words_at in zip((TEMPLATES[name] for name in titles), keyed, strict=True):
        templates.append(F.struct(strings(_phrase(notice)).alias("notice"), strings(_phrase(key)).alias("key"), F.lit(_key_place(notice, key)).alias("offset"), F.lit(len({w for w, _ in words_at})).alias("needed")))
    words, at = F.col("words"), F.col("at")
    agree = lambda part, begin: F.size(F.filter(F.transform(part, lambda w, k: F.get(words, begin + k) == w), lambda x: x))
    checked = let(F.get(F.array(*templates), F.col("template")), lambda m: F.struct((agree(m["key"], at + m["offset"]) == F.size(m["key"])).alias("ok"), (agree(m["notice"], at) / F.size(m["notice"])).alias("part"), m["needed"].alias("needed")))
    placed = spread.select(KEY, "template", "at", "w", checked.alias("c")).select(KEY, F.get(strings(titles), F.col("template")).alias("name"), "at", "w", "c.*").filter("ok")
    agreed = placed.groupBy(KEY, "name", "at").agg(F.count_distinct("w").alias("n"), F.max("part").alias("part"), F.max("needed").alias("needed")).filter("n >= needed")
    method = agreed.groupBy(KEY).agg(F.collect_set("name").alias("names"), F.max("part").alias("part"))

    joined = kept.drop("words", "hits").join(method, KEY, "left")
    spots = F.flatten(F.array(*[F.col(f"places.{label.replace('-', '_')}") for label in BASE.values()]))
    base = F.array_sort(F.filter(F.array(*[F.when(F.size(F.col(f"places.{label.replace('-', '_')}")) > 0, F.lit(label)) for label in BASE.values()]), lambda x: x.isNotNull()))
    none = F.array().cast("array<string>")
    out = joined.select(ID, KEY, "n_words", F.coalesce(spots, F.array().cast("array<int>")).alias("spots"), F.when(F.col("places").isNull(), none).otherwise(base).alias("base"), F.coalesce("names", none).alias("names"), F.coalesce("part", F.lit(0.0)).alias("part"))
    return out.select(
        ID, KEY, "n_words", F.size("spots").cast("long").alias("n_base"), F.array_min("spots").cast("long").alias("first_word"), F.array_max("spots").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", "names")), ",").alias("labels"),
        F.greatest("part", F.when(F.size("spots") > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = licences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.drop(KEY).withColumnRenamed(ID, "doc_id")


def oracle_sql() -> str:
    """DuckDB SQL for the query's rows; the templates are written into it."""
    lit = lambda s: f"'{s}'"
    templates = ", ".join(f"({lit(name)}, {_phrase(n)}, {_phrase(k)}, {_key_place(n, k)})" for name, (n, k) in sorted(TEMPLATES.items()))
    base = ", ".join(f"({lit(label)}, {_phrase(p)})" for p, label in BASE.items())
    return rf"""
WITH templates(name, notice, key, place) AS (VALUES {templates}),
phrases(label, phrase) AS (VALUES {base}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
words AS (SELECT r, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM d),
placed AS (SELECT r, name, i - place AS pos, notice, w FROM words JOIN templates ON word = key[1] JOIN d USING (r) WHERE w[i + 1:i + len(key)] = key),
part AS (SELECT r, name, pos, count_if(pos + k >= 0 AND w[pos + k + 1] = notice[k + 1]) / len(notice) AS part
         FROM (SELECT *, unnest(range(0, len(notice))) AS k FROM placed) GROUP BY r, name, pos, notice),
method AS (SELECT r, max(part) AS part FROM part GROUP BY r),
places AS (SELECT r, label, i FROM words JOIN phrases ON word = phrase[1] JOIN d USING (r) WHERE w[i + 1:i + len(phrase)] = phrase),
base AS (SELECT r, count(*) AS n, min(i) AS low, max(i) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM places GROUP BY r),
every AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM places UNION SELECT r, name FROM part) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(low AS BIGINT) AS first_word, CAST(high AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, greatest(coalesce(part, 0.0), CASE WHEN n > 0 THEN 0.5 ELSE 0.0 END) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN every USING (r) LEFT JOIN method USING (r)
"""
