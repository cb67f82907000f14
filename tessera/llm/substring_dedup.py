"""Removal of word windows that an earlier document already holds.

Every window of ``WINDOW`` consecutive words has an anchor: its least ``GRAM``
word sub-run.  Equal windows have equal anchors, so an anchor occurs in at
least as many documents as any of its windows.

1. First scan: each partition sketches its documents' anchors; the merged
   count-min sketch overestimates how many documents hold an anchor, and so
   overestimates how many hold any window it stands for.
2. Second scan: only windows estimated to repeat are written out, under a
   128-bit hash: two 64-bit ones, over two independent hashes of each word.
   Each batch first settles repeats within itself, so a window leaves a batch
   at most once however hot it is.
3. A window function finds the least document of each window exactly; later
   ones are removed.

Defined cases: null and empty texts have no words; a null id counts as larger
than every other id; rows that repeat an id are each judged against smaller
ids only, so neither removes the other; no rows in gives no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.bytescan import SPACES, U64, Words, anchors, blocks, mix, prefix, run_hash, text_buffers, window_starts
from tessera.llm.keyed import ID, KEY, TEXT, keyed, with_lists

WINDOW, GRAM = 50, 25
#: Bytes of text whose windows are settled together before anything is sent.
BATCH = 8 << 20
LAST_ID = np.iinfo(np.int64).max


def _anchored(words: Words, window: int, gram: int):
    """(prefix sums, grams, window starts, anchor of each window)."""
    sums = prefix(words.codes())
    starts = window_starts(words.first, window)
    if not len(starts):
        return sums, None, starts, starts
    at = np.arange(len(sums) - gram)
    grams = run_hash(sums, at, at + gram)
    return sums, grams, starts, anchors(grams, starts, window - gram + 1)


def _extract(window: int, gram: int):
    def extract(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = text_buffers(batch.column(0))
        for a, b in blocks(offsets):
            words = Words(data, offsets[a : b + 1], SPACES)
            _, grams, starts, anchor = _anchored(words, window, gram)
            if not len(starts):
                continue
            place = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
            doc = np.searchsorted(words.first, place, "right").astype(U64)
            # each anchor counts once per document
            _, one = np.unique(mix(grams[place]) + doc * U64(0x9E3779B97F4A7C15), return_index=True)
            yield grams[place[one]]

    return extract


def _schema() -> pa.Schema:
    return pa.schema([("h1", pa.int64()), ("h2", pa.int64()), (ID, pa.int64()), (KEY, pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("more", pa.binary())])


def _settle(parts: list[tuple[np.ndarray, ...]], window: int) -> Iterator[pa.RecordBatch]:
    """Send each distinct window of a batch once; later holders become removed spans."""
    h1, h2, doc, key, start = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((start, key, doc, h2, h1))
    h1, h2, doc, key, start = h1[order], h2[order], doc[order], key[order], start[order]
    new = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
    head = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    gone = doc > doc[head]
    # the least document's own repeats share one row: their starts ride along
    place = np.flatnonzero(~gone)
    lead = new[place] | np.r_[True, key[place][1:] != key[place][:-1]]
    first = place[lead]
    size = np.diff(np.r_[np.flatnonzero(lead), len(place)])
    more: list[bytes | None] = [None] * len(first)
    for k in np.flatnonzero(size > 1):
        more[k] = start[first[k] + 1 : first[k] + size[k]].astype("<i4").tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.array(x) for x in (h1[first].view(np.int64), h2[first].view(np.int64), doc[first], key[first], start[first].astype(np.int32), np.full(len(first), -1, np.int32))] + [pa.array(more, pa.binary())], schema=_schema()
    )
    doc, key, start = doc[gone], key[gone], start[gone]
    if not len(doc):
        return
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    cut = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] > start[:-1] + window)]
    first = np.flatnonzero(cut)
    last = np.r_[first[1:], len(doc)] - 1
    doc, key, begin, end = doc[first], key[first], start[first], start[last] + window
    own = mix(key.view(U64) ^ (begin.astype(U64) << U64(20)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (own.view(np.int64), own.view(np.int64), doc, key, begin.astype(np.int32), end.astype(np.int32))] + [pa.nulls(len(own), pa.binary())], schema=_schema())


def _windows(shared, width: int, window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = sketch.Repeated(shared.value, width)
        parts, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in blocks(offsets):
                words = Words(data, offsets[a : b + 1], SPACES)
                sums, grams, starts, anchor = _anchored(words, window, gram)
                if len(starts):
                    edge = np.r_[True, anchor[1:] != anchor[:-1]]
                    hit = repeated(grams[anchor[edge]])[np.cumsum(edge) - 1]
                    starts = starts[hit]
                if len(starts):
                    h1 = run_hash(sums, starts, starts + window)
                    h2 = run_hash(prefix(words.codes(1), 1), starts, starts + window, 1)
                    doc = np.searchsorted(words.first, starts, "right") - 1
                    parts.append((h1, h2, ids[a + doc], keys[a + doc], starts - words.first[doc]))
                size += int(offsets[b] - offsets[a])
                if size >= BATCH and parts:
                    yield from _settle(parts, window)
                    parts, size = [], 0
        if parts:
            yield from _settle(parts, window)

    return run


def removed_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(key, spans): word ranges of each document that earlier documents hold.  ``docs`` as from ``keyed``."""
    spark = docs.sparkSession
    width = sketch.width_for(sketch.text_bytes(docs, TEXT), 72)
    bits = sketch.merged(docs.select(TEXT), _extract(window, gram), width)
    shared = spark.sparkContext.broadcast(bits)
    rows = docs.select(ID, TEXT, KEY).mapInArrow(_windows(shared, width, window, gram), f"h1 long, h2 long, {ID} long, {KEY} long, start int, end int, more binary")
    least = F.min(ID).over(Window.partitionBy("h1", "h2"))
    gone = rows.withColumn("least", least).filter((F.col("end") >= 0) | (F.col(ID) > F.col("least")))
    span = F.struct("start", F.when(F.col("end") >= 0, F.col("end")).otherwise(F.col("start") + window).alias("end"), "more")
    return gone.groupBy(KEY).agg(F.collect_list(span).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        ids, spans = batch.column(0), batch.column(2)
        flat = spans.flatten()
        lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        more = flat.field(2)
        has_more = more.is_valid().to_numpy(zero_copy_only=False)
        at = np.r_[0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        n_words, n_removed, kept = [], [], []
        for a, b in blocks(offsets):
            words = Words(data, offsets[a : b + 1], SPACES)
            raw = words.data
            for i in range(a, b):
                first, last = words.first[i - a], words.first[i - a + 1]
                n = int(last - first)
                if at[i] == at[i + 1]:
                    stay = slice(first, last)
                    gone = 0
                else:
                    edge = np.zeros(n + 1, np.int64)
                    np.add.at(edge, lo[at[i] : at[i + 1]], 1)
                    np.add.at(edge, hi[at[i] : at[i + 1]], -1)
                    for k in at[i] + np.flatnonzero(has_more[at[i] : at[i + 1]]):
                        begin = np.frombuffer(more[k].as_buffer(), "<i4")
                        np.add.at(edge, begin, 1)
                        np.add.at(edge, begin + (hi[k] - lo[k]), -1)
                    free = np.cumsum(edge[:n]) == 0
                    stay = first + np.flatnonzero(free)
                    gone = n - len(stay)
                n_words.append(n)
                n_removed.append(gone)
                kept.append(_joined(raw, words.start[stay], words.end[stay]))
        yield pa.RecordBatch.from_arrays([ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], [ID, "n_words", "n_removed", "kept"])


def _joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Words joined by one space each."""
    if not len(start):
        return b""
    size = end - start + 1
    out = np.full(int(size.sum()), 32, np.uint8)
    to = np.cumsum(size) - size
    inside = np.arange(len(out)) - np.repeat(to, size)
    take = inside < np.repeat(size - 1, size)
    out[take] = raw[(np.repeat(start, size) + inside)[take]]
    return out[:-1].tobytes()


def substring_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, text): texts without the windows earlier documents hold."""
    base = keyed(docs, doc_id, text)
    cut = with_lists(base, removed_spans(base, window, gram)).select(ID, TEXT, "spans")
    out = cut.mapInArrow(_cut, f"{ID} long, n_words long, n_removed long, kept string")
    return out.select(F.col(ID).alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("text"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


#: Windows are compared by the 128-bit md5 of their words.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
windows AS (SELECT r, doc_id, s, md5_number(array_to_string(w[s:s + 49], ' ')) AS h FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM d)),
least AS (SELECT h, min(doc_id) AS first FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
bad AS (SELECT r, s FROM windows JOIN least USING (h) WHERE doc_id > first),
marked AS (SELECT words.r, p, word, max(s) OVER (PARTITION BY words.r ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone
           FROM words LEFT JOIN bad ON words.r = bad.r AND words.p = bad.s),
cut AS (SELECT r, count_if(gone) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT gone) AS kept FROM marked GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
