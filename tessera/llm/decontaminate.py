"""Benchmark passages in documents, by Wu-Manber search over words.

The alphabet is 64-bit word hashes.  Test strings are windows of consecutive
item words, grouped by length m.  A shift table over blocks of ``BLOCK`` words
tells how far the window may jump; all documents of a batch are scanned in
lock step, one lane each per stretch of words.  Where the shift is zero the
hash of the block that ends the window selects a bucket of test strings, and
the words' bytes are compared directly.

The test strings are read on the driver in blocks of at most ``MAX_WINDOWS``,
each broadcast and searched by a pass of its own, so the broadcast is bounded
whatever the size of the benchmark.

Defined cases: null texts have no words and no hits; items without words have
no window; repeated items count once by id, and items without an id are not
reported but their words count as hit; rows that repeat an id are scanned each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import SYMBOLS, U64, Words, blocks, mix, prefix, run_hash, text_buffers
from tessera.llm.keyed import ID, KEY, TEXT, keyed, matched

WINDOW, BLOCK = 10, 3
MAX_WINDOWS = 1 << 20
TABLE_BITS = 20
#: Words of a lane.
LANE = 512


class Patterns:
    """Test strings of one length: shift table, and buckets by the hash of the last block."""

    def __init__(self, m: int, texts: list[bytes], codes: np.ndarray, items: list[list[str]]):
        self.m, self.texts, self.items = m, texts, items
        self.block = min(BLOCK, m)
        hashes = _block_hash(codes.reshape(-1), self.block)
        self.shift = np.full(1 << TABLE_BITS, m - self.block + 1, np.uint8 if m < 256 else np.int32)
        base = np.arange(len(texts)) * m
        for j in range(m - self.block + 1):
            np.minimum.at(self.shift, _slot(hashes[base + j]), m - self.block - j)
        tail = hashes[base + m - self.block]
        self.order = np.argsort(tail, kind="stable")
        self.tail = tail[self.order]
        whole = run_hash(prefix(codes.reshape(-1)), base, base + m)
        self.whole = np.sort(whole)


def _block_hash(code: np.ndarray, block: int) -> np.ndarray:
    n = max(0, len(code) - block + 1)
    out = np.zeros(n, U64)
    for k in range(block):
        out = mix(out + code[k : k + n]) * U64(0x9E3779B97F4A7C15)
    return out


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - TABLE_BITS)).astype(np.int64)


def words_of(texts: pa.Array) -> tuple[Words, np.ndarray]:
    data, offsets = text_buffers(texts)
    words = Words(data, offsets, SYMBOLS, lower=True)
    return words, words.codes()


def compile_items(ids: list, texts: list, window: int) -> list[Patterns]:
    """Tables for the windows of these items."""
    words, code = words_of(pa.array(texts, pa.large_string()))
    raw = words.data.tobytes()
    found: dict[int, dict[bytes, tuple[np.ndarray, set]]] = defaultdict(dict)
    for k, item in enumerate(ids):
        lo, hi = int(words.first[k]), int(words.first[k + 1])
        m = min(window, hi - lo)
        for i in range(lo, hi - m + 1 if m else lo):
            text = b" ".join(raw[words.start[j] : words.end[j]] for j in range(i, i + m))
            found[m].setdefault(text, (code[i : i + m], set()))[1].update([] if item is None else [str(item)])
    return [Patterns(m, list(some), np.stack([c for c, _ in some.values()]), [sorted(s) for _, s in some.values()]) for m, some in sorted(found.items())]


def search(words: Words, code: np.ndarray, patterns: Patterns) -> Iterator[tuple[int, int]]:
    """(first word, pattern) of every occurrence within one document."""
    m = patterns.m
    size = np.diff(words.first) - m + 1
    docs = np.flatnonzero(size > 0)
    if not len(docs):
        return
    hashes = _block_hash(code, patterns.block)
    lanes = -(-size[docs] // LANE)
    lane_of = np.repeat(np.arange(len(docs)), lanes)
    nth = np.arange(len(lane_of)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    at = words.first[docs][lane_of] + nth * LANE
    stop = np.minimum(at + LANE, (words.first[docs] + size[docs])[lane_of])
    ends = m - patterns.block
    zero = []
    while len(at):
        shift = patterns.shift[_slot(hashes[at + ends])]
        zero.append(at[shift == 0])
        at = at + np.maximum(shift, 1)
        live = at < stop
        at, stop = at[live], stop[live]
    at = np.concatenate(zero)
    if not len(at):
        return
    tail = hashes[at + ends]
    low = np.searchsorted(patterns.tail, tail, "left")
    high = np.searchsorted(patterns.tail, tail, "right")
    whole = run_hash(prefix(code), at, at + m)
    spot = np.minimum(np.searchsorted(patterns.whole, whole), len(patterns.whole) - 1)
    for k in np.flatnonzero((low < high) & (patterns.whole[spot] == whole)):
        i = int(at[k])
        text = b" ".join(words.data[words.start[j] : words.end[j]].tobytes() for j in range(i, i + m))
        for p in patterns.order[low[k] : high[k]]:
            if patterns.texts[p] == text:
                yield i, int(p)


def _scan(shared):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: list[Patterns] = shared.value
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n_words, hits, items = [], [], []
            for a, b in blocks(offsets):
                words = Words(data, offsets[a : b + 1], SYMBOLS, lower=True)
                n_words.append(np.diff(words.first))
                code = words.codes()
                spans: dict[int, list] = defaultdict(list)
                seen: dict[int, set] = defaultdict(set)
                for patterns in tables:
                    for i, p in search(words, code, patterns):
                        doc = int(np.searchsorted(words.first, i, "right")) - 1
                        spans[doc].append((i - int(words.first[doc]), i - int(words.first[doc]) + patterns.m))
                        seen[doc].update(patterns.items[p])
                for doc in range(b - a):
                    hits.append([{"start": s, "end": e} for s, e in _union(spans[doc])] if doc in spans else [])
                    items.append(sorted(seen[doc]) if doc in seen else [])
            count = np.concatenate(n_words) if n_words else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(count.astype(np.int64)), pa.array(hits, pa.list_(span)), pa.array(items, pa.list_(pa.string()))], [ID, KEY, "n_words", "hits", "items"])

    return run


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[list[Patterns]]:
    ids, texts, n = [], [], 0
    for row in benchmark.select(F.col(item_id), F.col(text)).toLocalIterator():
        ids.append(row[0]), texts.append(row[1] or "")
        n += 1 + len(texts[-1]) // 2
        if n >= MAX_WINDOWS:
            yield compile_items(ids, texts, window)
            ids, texts, n = [], [], 0
    yield compile_items(ids, texts, window)


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, key, n_words, hits, items): per row the word spans that items hold, and those items."""
    spark = docs.sparkSession
    base = keyed(docs, doc_id, text).select(ID, TEXT, KEY)
    schema = f"{ID} long, {KEY} long, n_words long, hits array<struct<start:long,end:long>>, items array<string>"
    passes = [base.mapInArrow(_scan(spark.sparkContext.broadcast(tables)), schema) for tables in _item_blocks(benchmark, item_id, item_text, window)]
    if len(passes) == 1:
        return passes[0]
    found = passes[0].withColumn("nth", F.lit(0))
    for k, more in enumerate(passes[1:], 1):
        found = found.union(more.withColumn("nth", F.lit(k)))
    rows = found.groupBy(ID, KEY).agg(F.count_if(F.col("nth") == 0).alias("n_rows"), F.max("n_words").alias("n_words"), F.flatten(F.collect_set("hits")).alias("hits"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    return rows.select(ID, KEY, "n_words", "hits", "items", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")).alias("nth")).drop("nth")


def hit_words(spans: str = "hits"):
    """Words covered by any span."""
    begin = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["end"], s["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(acc["end"], s["start"]))).alias("n"))
    return F.aggregate(F.array_sort(spans), begin, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no window of an item."""
    bad = contamination(docs, benchmark, doc_id, text, **how).filter(F.size("hits") > 0)
    return matched(docs, bad, "left_anti", doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contamination(docs, items)
    return found.select(F.col(ID).alias("doc_id"), "n_words", hit_words().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


#: Words hold no space, so a joined window has one reading.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
tests AS (SELECT DISTINCT item_id, m, array_to_string(w[s:s + m - 1], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM b WHERE len(w) > 0)),
windows AS (SELECT r, s, m, array_to_string(w[s:s + m - 1], ' ') AS t FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM tests))),
found AS (SELECT r, s, windows.m, item_id FROM windows JOIN tests ON windows.t = tests.t),
spans AS (SELECT r, s, max(s + m) AS e FROM found GROUP BY r, s),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p FROM d),
marked AS (SELECT words.r, p < max(e) OVER (PARTITION BY words.r ORDER BY p) AS hit FROM words LEFT JOIN spans ON words.r = spans.r AND words.p = spans.s),
hits AS (SELECT r, count_if(hit) AS n FROM marked GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(list, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""
