"""Removal of byte strings that occur earlier, by a logarithmic family of suffix arrays.

A string here is ``LENGTH`` bytes of UTF-8.  Each is assigned to its anchor,
its least ``GRAM`` byte sub-run, and the consecutive strings of one anchor
travel together with their bytes as one *context*, so that all occurrences of
a string meet in one shard.  Strings whose anchor the corpus-wide count-min
sketch shows only once cannot repeat and are never sent.

A shard reads its contexts in document order.  Each new batch gets a suffix
array: its positions in the order of the ``LENGTH`` bytes that begin there,
sorted by eight bytes at a time among those still tied.  The sorted batch is
scanned against every existing level, itself sorted the same way, for matches
of ``LENGTH`` bytes.  What is new becomes a level, and levels of equal size
merge, so a shard keeps O(log n) levels, each string once.  All comparisons
are of bytes; hashes only route, and group contexts whose bytes are compared.

Defined cases: null texts are empty; documents shorter than ``LENGTH`` are
kept whole; order is (id, text hash, start), null ids last; a row repeated
exactly is not earlier than itself; no rows in gives no rows out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import sketch
from tessera.llm.bytescan import BYTE_CODE, U64, anchors, blocks, mix, prefix, run_hash, text_buffers, window_starts
from tessera.llm.keyed import ID, KEY, TEXT, keyed, with_lists

LENGTH, GRAM = 100, 40
LAST_ID = np.iinfo(np.int64).max
#: Bytes of text whose contexts are compared before any is sent.
BATCH = 8 << 20
#: Suffixes of a level-0 array.
LEVEL0 = 1 << 19
#: Strings whose bytes are gathered at a time.
GATHER = 1 << 15
_ORDER = U64(0xBF58476D1CE4E5B9)


def _anchored(data: np.ndarray, first: np.ndarray, length: int, gram: int):
    """(prefix sums, window starts, anchor of each window)."""
    sums = prefix(BYTE_CODE[data])
    starts = window_starts(first, length)
    if not len(starts):
        return sums, starts, starts
    n = len(data) - gram + 1
    raw = (sums[gram:] - sums[:n]) * _inverse_powers(n)
    raw *= _ORDER
    return sums, starts, anchors(raw, starts, length - gram + 1)


def _inverse_powers(n: int) -> np.ndarray:
    from tessera.llm.bytescan import _INVERSES, powers

    return powers(_INVERSES[0], n)


def _groups(first: np.ndarray, starts: np.ndarray, anchor: np.ndarray):
    """Runs of consecutive windows of one document with one anchor: (first window, count, anchor, document)."""
    lead = np.r_[True, (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)]
    at = np.flatnonzero(lead)
    count = np.diff(np.r_[at, len(starts)])
    return starts[at], count, anchor[at], np.searchsorted(first, starts[at], "right") - 1


def _extract(length: int, gram: int):
    def extract(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        data, offsets = text_buffers(batch.column(0))
        for a, b in blocks(offsets):
            part, first = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            sums, starts, anchor = _anchored(part, first, length, gram)
            if len(starts):
                place = anchor[np.r_[True, anchor[1:] != anchor[:-1]]]
                yield run_hash(sums, place, place + gram)

    return extract


_SENT = pa.schema([("g", pa.int64()), (ID, pa.int64()), (KEY, pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("context", pa.binary())])


def _settle(parts: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """Send each distinct context of a batch once; repeats of it become removed spans (without bytes).
    A repeat is found by two hashes and confirmed on its bytes."""
    g, c1, c2, doc, key, start, n, block = (np.concatenate(x) for x in zip(*(p[:8] for p in parts), strict=True))
    raw = [p[8] for p in parts]
    place = np.concatenate([p[9] for p in parts])
    order = np.lexsort((start, key, doc, c2, c1))
    s1, s2 = c1[order], c2[order]
    new = np.r_[True, (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])]
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    same = (doc[order] == doc[head]) & (key[order] == key[head]) & (start[order] == start[head])
    send = order[new]

    def content(i: int) -> bytes:
        return raw[block[i]][place[i] : place[i] + n[i] + length - 1].tobytes()

    context: list[bytes | None] = [content(i) for i in send]
    repeat = ~new & ~same
    gone = order[repeat]
    equal = np.fromiter((content(i) == context[k] for i, k in zip(gone, (np.cumsum(new) - 1)[repeat], strict=True)), bool, len(gone))
    context += [content(i) for i in gone[~equal]]
    send, gone = np.r_[send, gone[~equal]], gone[equal]
    context += [None] * len(gone)
    both = np.r_[send, gone]
    route = g[both].view(np.int64).copy()
    route[len(send) :] = key[gone] ^ start[gone]
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, doc[both], key[both], start[both].astype(np.int32), n[both].astype(np.int32))] + [pa.array(context, pa.binary())], schema=_SENT)


def _contexts(shared, width: int, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = sketch.Repeated(shared.value, width)
        parts, size = [], 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)
            keys = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in blocks(offsets):
                part, first = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                size += len(part)
                sums, starts, anchor = _anchored(part, first, length, gram)
                if len(starts):
                    start, n, anchor, doc = _groups(first, starts, anchor)
                    g = run_hash(sums, anchor, anchor + gram)
                    hit = repeated(g)
                    start, n, g, doc = start[hit], n[hit], g[hit], doc[hit]
                    if len(start):
                        end = start + n + length - 1
                        c1 = run_hash(sums, start, end) ^ mix(n.astype(U64))
                        c2 = run_hash(prefix(mix(BYTE_CODE[part]), 1), start, end, 1)
                        parts.append((g, c1, c2, ids[a + doc], keys[a + doc], start - first[doc], n, np.full(len(g), len(parts)), part, start))
                if size >= BATCH and parts:
                    yield from _settle(parts, length)
                    parts, size = [], 0
        if parts:
            yield from _settle(parts, length)

    return run


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each position as a number that orders as they do."""
    padded = np.r_[text, np.zeros(8, np.uint8)]
    return np.ndarray((len(text),), ">u8", padded, strides=(1,))


def _steps(length: int) -> list[int]:
    """Offsets whose eight bytes together are the ``length`` bytes of a string, in order."""
    return [min(d, length - 8) for d in range(0, length, 8)]


def _compare(text_a: np.ndarray, a: np.ndarray, text_b: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """-1, 0 or 1 as the string at each place of ``a`` is below, equal to or above that of ``b``."""
    out = np.empty(len(a), np.int8)
    strings_a, strings_b = (np.lib.stride_tricks.sliding_window_view(x, length) for x in (text_a, text_b))
    for i in range(0, len(a), GATHER):
        x, y = strings_a[a[i : i + GATHER]], strings_b[b[i : i + GATHER]]
        differ = x != y
        row, byte = np.arange(len(x)), differ.argmax(1)
        x, y = x[row, byte], y[row, byte]
        out[i : i + GATHER] = (x > y).astype(np.int8) - (x < y)
    return out


def suffix_array(text: np.ndarray, words: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, lead): ``at`` sorted by its strings, and where in that order a new string begins."""
    key = words[at].astype(U64)
    order = np.argsort(key)
    key = key[order]
    lead = np.r_[True, key[1:] != key[:-1]]
    tied = np.flatnonzero(~lead | ~np.r_[lead[1:], True])
    for depth, step in enumerate(_steps(length)[1:], 1):
        if depth & depth - 1 == 0 and len(tied):  # after 1, 2, 4, 8 words: leave groups that are one string
            head = np.maximum.accumulate(np.where(lead[tied], tied, 0))
            unequal = _compare(text, at[order[tied]], text, at[order[head]], length) != 0
            mixed = np.zeros(len(order), bool)
            mixed[head[unequal]] = True
            tied = tied[mixed[head]]
        if not len(tied):
            break
        word = words[at[order[tied]] + step].astype(U64)
        group = np.cumsum(lead[tied])
        turn = np.lexsort((word, group))
        order[tied] = order[tied][turn]
        word = word[turn]
        lead[tied] |= np.r_[True, word[1:] != word[:-1]]
        tied = tied[~lead[tied] | ~np.r_[lead[1:], True][tied]]
    return order, lead


class Level:
    """A suffix array of distinct strings: their places in ``text`` in the order of their bytes."""

    def __init__(self, text: np.ndarray, places: np.ndarray, key: np.ndarray | None = None, words: np.ndarray | None = None):
        self.text, self.places = text, places
        self.words = _words(text) if words is None else words
        self.key = self.words[places].astype(U64) if key is None else key

    def _bound(self, word: np.ndarray, step: int, low: np.ndarray, high: np.ndarray, above: bool) -> np.ndarray:
        """First rank in [low, high) whose word at ``step`` is at least (``above``: more than) ``word``."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            here = self.words[self.places[middle] + step].astype(U64)
            up = here <= word[open_] if above else here < word[open_]
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]
            open_ = open_[low[open_] < high[open_]]
        return low

    def scan(self, other: "Level", length: int) -> tuple[np.ndarray, np.ndarray]:
        """(rank, found): where each string of ``other``, in order, stands or would stand here, and whether it does."""
        rank = np.searchsorted(self.key, other.key)
        found = np.zeros(len(rank), bool)
        live = np.flatnonzero(rank < len(self.key))
        live = live[self.key[rank[live]] == other.key[live]]
        high = np.searchsorted(self.key, other.key[live], "right")
        for step in [*_steps(length)[1:], None]:
            single = high - rank[live] == 1
            if single.any():
                one = live[single]
                side = _compare(other.text, other.places[one], self.text, self.places[rank[one]], length)
                found[one[side == 0]] = True
                rank[one[side > 0]] += 1
            live, high = live[~single], high[~single]
            if not len(live) or step is None:
                break
            word = other.words[other.places[live] + step].astype(U64)
            low = rank[live]
            rank[live] = self._bound(word, step, low, high, False)
            high = self._bound(word, step, rank[live], high, True)
            still = high > rank[live]
            live, high = live[still], high[still]
        return rank, found

    def merge(self, other: "Level", length: int) -> "Level":
        """Both in one order; they share no string."""
        spot = self.scan(other, length)[0] + np.arange(len(other.places))
        mine = np.ones(len(self.places) + len(other.places), bool)
        mine[spot] = False
        places, key = np.empty(len(mine), np.int64), np.empty(len(mine), U64)
        places[mine], places[spot] = self.places, other.places + len(self.text)
        key[mine], key[spot] = self.key, other.key
        return Level(np.r_[self.text, other.text], places, key)


class SuffixFamily:
    """Suffix arrays of a shard, of geometrically growing sizes."""

    def __init__(self, length: int):
        if length < 8:
            raise ValueError("strings of at least 8 bytes are compared")
        self.length = length
        self.levels: list[Level] = []

    def add(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For the strings at ``at`` (in document order): the place in ``at`` of the first equal
        one in this batch, or -1 where a level already holds it.  What is new becomes a level."""
        words = _words(text)
        order, lead = suffix_array(text, words, at, self.length)
        heads = np.minimum.reduceat(order, np.flatnonzero(lead))
        group = np.cumsum(lead) - 1
        new = np.ones(len(heads), bool)
        batch = Level(text, at[heads], words=words)
        for level in self.levels:
            new &= ~level.scan(batch, self.length)[1]
        first = np.empty(len(at), np.int64)
        first[order] = np.where(new, heads, -1)[group]
        if new.any():
            self._push(Level(text, batch.places[new], batch.key[new], words))
        return first

    def _push(self, level: Level) -> None:
        self.levels.append(level)
        while len(self.levels) > 1 and len(self.levels[-1].key) * 2 > len(self.levels[-2].key):
            newer = self.levels.pop()
            self.levels[-1] = self.levels[-1].merge(newer, self.length)


def _shard(length: int):
    schema = pa.schema([(KEY, pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def spans(key, start, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = SuffixFamily(length)
        held: list[tuple] = []
        n_held = 0

        def settle() -> Iterator[pa.RecordBatch]:
            doc, key, start, n = (np.concatenate([h[k] for h in held]) for k in range(4))
            text = np.frombuffer(b"".join(h[4] for h in held), np.uint8)
            size = n + length - 1
            base = np.cumsum(size) - size
            owner = np.repeat(np.arange(len(n)), n)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            first = family.add(text, base[owner] + inner)
            at = start[owner] + inner
            j = np.maximum(first, 0)
            same = (key[owner] == key[owner[j]]) & (doc[owner] == doc[owner[j]]) & (at == at[j])
            gone = np.flatnonzero((first < 0) | ~same)
            if len(gone):
                lead = np.r_[True, (owner[gone][1:] != owner[gone][:-1]) | (gone[1:] != gone[:-1] + 1)]
                a = gone[lead]
                b = gone[np.r_[np.flatnonzero(lead)[1:], len(gone)] - 1]
                yield spans(key[owner[a]], at[a], at[b] + length)

        for batch in batches:
            doc, key, start, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            live = batch.column(5).is_valid().to_numpy(zero_copy_only=False)
            if not live.all():
                yield spans(key[~live], start[~live], start[~live] + n[~live] + length - 1)
            rows = np.flatnonzero(live)
            cut = 0
            for stop in [*np.flatnonzero(np.diff((np.cumsum(n[rows]) + n_held) // LEVEL0)) + 1, len(rows)]:
                some = rows[cut:stop]
                cut = stop
                if len(some):
                    held.append((doc[some], key[some], start[some].astype(np.int64), n[some].astype(np.int64), b"".join(batch.column(5).take(pa.array(some)).to_pylist())))
                    n_held += int(n[some].sum())
                if n_held >= LEVEL0:
                    yield from settle()
                    held, n_held = [], 0
        if held:
            yield from settle()

    return run


def removed_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, spans): byte ranges that occur earlier.  ``docs`` as from ``keyed``."""
    spark = docs.sparkSession
    width = sketch.width_for(sketch.text_bytes(docs, TEXT), 30)
    bits = sketch.merged(docs.select(TEXT), _extract(length, gram), width)
    shared = spark.sparkContext.broadcast(bits)
    sent = docs.select(ID, TEXT, KEY).mapInArrow(_contexts(shared, width, length, gram), f"g long, {ID} long, {KEY} long, start int, n int, context binary")
    shards = sent.repartition(F.col("g")).sortWithinPartitions(ID, KEY, "start")
    gone = shards.mapInArrow(_shard(length), f"{KEY} long, start int, end int")
    return gone.groupBy(KEY).agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = text_buffers(batch.column(1))
        spans = batch.column(2)
        flat = spans.flatten()
        lo, hi = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        at = np.r_[0, np.cumsum(spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]
        n_removed, n_spans, kept = [], [], []
        for i in range(len(offsets) - 1):
            raw = data[offsets[i] : offsets[i + 1]]
            if at[i] == at[i + 1]:
                n_removed.append(0), n_spans.append(0), kept.append(raw.tobytes())
                continue
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, lo[at[i] : at[i + 1]], 1)
            np.add.at(edge, hi[at[i] : at[i + 1]], -1)
            gone = np.cumsum(edge[:-1]) > 0
            n_removed.append(int(gone.sum()))
            n_spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
            kept.append(raw[~gone].tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())], [ID, "n_bytes", "n_removed", "n_spans", "kept"]
        )


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): the bytes of each document without earlier strings."""
    base = keyed(docs, doc_id, text)
    cut = with_lists(base, removed_spans(base, length, gram)).select(ID, TEXT, "spans")
    out = cut.mapInArrow(_cut, f"{ID} long, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed(ID, "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Hexadecimal texts are cut into blocks of 100 bytes, so that taking a window never walks a long text.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (SELECT r, doc_id, j, substring(x, 200 * j + 1, 400) AS y FROM (SELECT r, doc_id, x, unnest(range(0, (len(x) + 199) // 200)) AS j FROM d)),
bytes AS (SELECT r, doc_id, 100 * j + k AS p, substring(y, 2 * k + 1, 2) AS byte, CASE WHEN len(y) >= 2 * k + 200 THEN md5_number(substring(y, 2 * k + 1, 200)) END AS h
          FROM (SELECT r, doc_id, j, y, unnest(range(0, least(100, len(y) // 2))) AS k FROM blocks)),
least AS (SELECT h, min((doc_id, p)) AS first FROM bytes WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
starts AS (SELECT r, p, byte, CASE WHEN (doc_id, p) > first THEN p END AS s FROM bytes LEFT JOIN least ON bytes.h = least.h),
marked AS (SELECT r, p, byte, max(s) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) IS NOT NULL AS gone FROM starts),
edges AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY p), false) AS opens FROM marked),
cut AS (SELECT r, count_if(gone) AS n, count_if(opens) AS spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM edges GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
