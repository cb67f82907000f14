"""Token ids of whole texts in Parquet list columns that can be read selectively.

Documents are range-partitioned by id, encoded, and written in ascending order:
one row per document, the ids as a dictionary-encoded list column, the id and
offset columns delta-encoded, row groups and pages of controlled size, and the
page indexes Parquet writes with them, so that a reader of some documents or of
the metadata alone touches only their pages.

Encoding goes by pieces, cut where the tokenizer's own splitting always cuts:
at the start of a run of white space, before the run's last character, after
that character unless it is a space, which belongs to the word behind it, and
between ASCII letters, digits and signs.
Pieces of up to ``SHORT`` bytes are looked up, many at once, in a table whose
keys are the bytes themselves; longer ones of up to ``LONG`` bytes are
remembered by a dictionary of bounded size, and others are encoded each time.
Texts that hold a string of an added token are encoded whole, as are all texts
under a tokenizer of another kind.

Defined cases: null and empty texts give the end id alone; ties of id are
ordered by a hash of the text, null ids come first; repeated rows are repeated;
other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.bytescan import U64, blocks, text_buffers
from tessera.llm.keyed import ID, KEY, TEXT, keyed
from tessera.llm.workspace import fresh_path

END_ID = 0
#: Bytes of a row group and of a page, and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 32 << 20, 256 << 10, 2000
#: Bytes of a piece whose key is exact, and of a piece remembered at all.
SHORT, LONG = 15, 64
#: Pieces remembered at most, short and long; beyond it the memory starts anew.
PIECES, LONG_PIECES = 3 << 19, 1 << 17
#: Pieces encoded in one call.
JOIN = 256

_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def odd_spaces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of white space beyond ASCII, and of the ASCII separators that some take for white space."""
    at = np.flatnonzero((data - np.uint8(0xE1) < 3) | (data == 0xC2) | (data - np.uint8(0x1C) < 4))
    if not len(at):
        return at, at
    a, b, c = (np.append(data, np.zeros(2, np.uint8))[at + k].astype(np.int64) for k in range(3))
    three = a << 16 | b << 8 | c
    two = (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    wide = np.isin(three, (0xE19A80, 0xE1A08E, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080)) | ((three >= 0xE28080) & (three <= 0xE2808A))
    size = (a < 0x20) * 1 + two * 2 + wide * 3
    hit = size > 0
    return at[hit], (at + size)[hit]


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Flags of the bytes where a piece begins; ``offsets`` are those of whole texts that fill ``data``."""
    flag = np.zeros(len(data), bool)
    if not len(data):
        return flag
    begins, stops = offsets[:-1][offsets[:-1] < len(data)], offsets[1:][offsets[1:] > 0]
    space = (data - np.uint8(9) < 5) | (data == 32)
    before, behind = np.empty_like(space), np.empty_like(space)
    before[1:], behind[:-1] = space[:-1], space[1:]
    before[begins] = False  # no run crosses texts
    behind[stops - 1] = True  # and one at the end of a text is one piece
    inner = space & ~behind
    flag |= space & ~before
    flag |= inner
    flag[1:] |= (inner & (data != 32))[:-1]
    # ASCII letters, digits and signs: a run of one ends where another begins, but a letter may belong to an apostrophe before it
    letter, digit = (data | 32) - np.uint8(97) < 26, data - np.uint8(48) < 10
    sign = (data - np.uint8(33) < 94) & ~letter & ~digit
    flag[1:] |= letter[:-1] & (digit | sign)[1:]
    flag[1:] |= digit[:-1] & (letter | sign)[1:]
    flag[1:] |= sign[:-1] & digit[1:]
    for a, b in zip(*odd_spaces(data), strict=True):  # runs of one text beside other white space stay within their piece
        low, high, stop = a, b, offsets[np.searchsorted(offsets, a, "right")]
        while before[low]:
            low -= 1
        while high < stop and space[high]:
            high += 1
        if low < a or high > b:
            flag[low : high + 1] = False
    flag[begins] = True
    return flag


class _Pool:
    """Variable-length runs of ids by number; both arrays grow by doubling."""

    def __init__(self, first: list[int]):
        self.flat, self.begin = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int64)
        self.n = self.n_flat = 0
        self.add(np.array(first, np.int32), np.array([len(first)]))

    def add(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of the new runs."""
        while self.n_flat + len(flat) > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while self.n + len(size) + 1 > len(self.begin):
            self.begin = np.r_[self.begin, np.zeros_like(self.begin)]
        self.flat[self.n_flat : self.n_flat + len(flat)] = flat
        self.begin[self.n + 1 : self.n + len(size) + 1] = self.n_flat + np.cumsum(size)
        out = np.arange(self.n, self.n + len(size))
        self.n += len(size)
        self.n_flat += len(flat)
        return out

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each)."""
        begin = self.begin[numbers]
        size = self.begin[numbers + 1] - begin
        stop = np.cumsum(size)
        total = int(stop[-1]) if len(stop) else 0
        place = np.repeat(begin - (stop - size), size)
        place += np.arange(total)
        return self.flat[place], size


class _Table:
    """Open addressing over exact 128-bit keys; ``hi`` of a key is never 0."""

    def __init__(self, bits: int):
        self.shift, self.last = U64(64 - bits), (1 << bits) - 1
        self.lo, self.hi = np.zeros(1 << bits, U64), np.zeros(1 << bits, U64)
        self.number = np.zeros(1 << bits, np.int32)

    def _slot(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        h = lo * U64(0x9E3779B97F4A7C15) ^ hi * U64(0xC2B2AE3D27D4EB4F)
        h ^= h >> U64(29)
        h *= U64(0xBF58476D1CE4E5B9)
        return (h >> self.shift).astype(np.int64)

    def find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Numbers of the keys, -1 where absent."""
        slot = self._slot(lo, hi)
        out = self.number[slot]
        left = np.flatnonzero((self.hi[slot] != hi) | (self.lo[slot] != lo))
        while len(left):
            here = slot[left]
            empty = self.hi[here] == 0
            out[left[empty]] = -1
            same = (self.hi[here] == hi[left]) & (self.lo[here] == lo[left])
            out[left[same]] = self.number[here[same]]
            left = left[~empty & ~same]
            slot[left] = (slot[left] + 1) & self.last
        return out

    def put(self, lo: np.ndarray, hi: np.ndarray, number: np.ndarray) -> None:
        """Keys that are absent and distinct."""
        slot = self._slot(lo, hi)
        left = np.arange(len(lo))
        while len(left):
            free = left[self.hi[slot[left]] == 0]
            _, one = np.unique(slot[free], return_index=True)
            took = free[one]
            self.lo[slot[took]], self.hi[slot[took]], self.number[slot[took]] = lo[took], hi[took], number[took]
            rest = np.ones(len(lo), bool)
            rest[took] = False
            left = left[rest[left]]
            slot[left] = (slot[left] + 1) & self.last


class Encoder:
    """Encodes whole texts to ids, each with the end id, as the library's plain call does."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        facts = json.loads(self.tokenizer.to_str())
        split = facts["pre_tokenizer"] or {}
        self.added = [t["content"].encode() for t in facts["added_tokens"]]
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and facts["normalizer"] is None and not any(b" " in t for t in self.added)
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[k for token, k in self.tokenizer.get_vocab().items() if token[0] == "\u0120"]] = True
        self.end_id = end_id
        self._reset()

    def _reset(self) -> None:
        # number 0 of the pieces is the end id
        self.short, self.long, self.pool = _Table((2 * PIECES).bit_length() - 1), {}, _Pool([self.end_id])

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new pieces of ``data``.

        Words after a space, without another and with no byte that other white space begins with,
        are encoded many at a call: the ids that begin with the space tell them apart.
        """
        if not len(start):
            return start
        begin = np.cumsum(size) - size
        byte = data[np.repeat(start - begin, size) + np.arange(int(size.sum()))]
        doubt = (byte - np.uint8(0xE1) < 3) | (byte == 0xC2) | (byte < 0x20)
        joint = (size > 1) & (data[start] == 32) & (np.add.reduceat((byte == 32).astype(np.int64), begin) == 1) & ~np.logical_or.reduceat(doubt, begin)
        order = np.r_[np.flatnonzero(joint), np.flatnonzero(~joint)]
        n = int(joint.sum())
        start, size = start[order], size[order]
        begin = np.cumsum(size) - size
        raw = data[np.repeat(start - begin, size) + np.arange(len(byte))].tobytes()
        cuts = np.r_[begin[:n:JOIN], begin[n:], len(raw)].tolist()
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)], add_special_tokens=False)]
        calls = -(-n // JOIN)
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        n_joint = sum(map(len, ids[:calls]))
        count = np.empty(len(order), np.int64)
        count[:n] = np.diff(np.r_[np.flatnonzero(self.spaced[flat[:n_joint]]), n_joint])
        count[n:] = [len(x) for x in ids[calls:]]
        numbers = np.empty(len(order), np.int64)
        numbers[order] = self.pool.add(flat, count)
        return numbers

    def _short(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
        lo = words[start] & _MASK[np.minimum(size, 8)]
        hi = words[start + 8] & _MASK[np.maximum(size - 8, 0)] | size.astype(U64) << U64(56)
        number = self.short.find(lo, hi)
        new = np.flatnonzero(number < 0)
        if len(new):
            order = new[np.lexsort((lo[new], hi[new]))]
            lead = np.r_[True, (lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])]
            one = order[lead]
            numbers = self._learn(padded, start[one], size[one])
            self.short.put(lo[one], hi[one], numbers)
            number[order] = numbers[np.cumsum(lead) - 1]
        return number

    def _long(self, padded: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        raw = memoryview(padded)
        out = np.empty(len(start), np.int64)
        fresh, where = {}, []
        for k, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True)):
            piece = bytes(raw[a : a + n])
            number = self.long.get(piece)
            if number is None:
                if piece not in fresh:
                    fresh[piece] = k
                where.append((k, piece))
            else:
                out[k] = number
        if fresh:
            at = np.fromiter(fresh.values(), np.int64)
            numbers = dict(zip(fresh, self._learn(padded, start[at], size[at]).tolist(), strict=True))
            for k, piece in where:
                out[k] = numbers[piece]
            self.long.update((piece, n) for piece, n in numbers.items() if len(piece) <= LONG)
        return out

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); the texts are ``data`` between the offsets, which fill it."""
        if self.pool.n > PIECES or len(self.long) > LONG_PIECES or self.pool.n_flat > 8 * PIECES:
            self._reset()
        padded = np.append(data, np.zeros(24, np.uint8))
        flag = piece_starts(data, offsets) if self.by_piece else np.zeros(len(data), bool)
        flag[offsets[offsets < len(data)]] = True
        whole = data.tobytes()
        for token in self.added:
            place = whole.find(token)
            while place >= 0:  # its text is one piece
                k = int(np.searchsorted(offsets, place, "right"))
                flag[offsets[k - 1] + 1 : offsets[k]] = False
                place = whole.find(token, int(offsets[k]))
        start = np.flatnonzero(flag)
        size = np.diff(np.r_[start, len(data)])
        number = np.empty(len(start), np.int64)
        short = size <= SHORT
        number[short] = self._short(padded, start[short], size[short])
        long = np.flatnonzero(~short)
        number[long] = self._long(padded, start[long], size[long])
        # the end id after the last piece of every text
        stop = np.searchsorted(start, offsets[1:])
        ids, count = self.pool.get(np.insert(number, stop, 0))
        upto = np.r_[0, np.cumsum(count)][stop + np.arange(1, len(stop) + 1)]
        return ids, np.diff(np.r_[0, upto])


_encoders: dict[tuple, Encoder] = {}


def encoder_for(path: str, end_id: int) -> Encoder:
    """A worker's encoder outlives the task, with what it remembers."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _encode(path: str, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(path, end_id)
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            for a, b in blocks(offsets):
                ids, size = encoder(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                begin = start + np.cumsum(size) - size
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.full(len(size), part, np.int32)), pa.array(begin), pa.array(size), lists], schema=schema)
                start += int(size.sum())

    return run


def write_ids(docs: DataFrame, out: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encode ``docs`` and write them below ``out``; row groups and pages of about so many bytes."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keyed(docs, doc_id, text).repartitionByRange(n, ID, KEY).sortWithinPartitions(ID, KEY).select(ID, TEXT)
    rows = ordered.mapInArrow(_encode(tokenizer, end_id), "doc_id long, part int, start_in_part long, n_tokens long, ids array<int>")
    options = {
        "parquet.block.size": row_group, "parquet.page.size": page, "parquet.page.row.count.limit": PAGE_ROWS,
        "parquet.writer.version": "v2", "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#start_in_part": "false", "compression": "zstd",
    }
    rows.write.options(**options).parquet(out)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ``start`` counts the ids of all documents before."""
    rows = spark.read.parquet(path)
    # one row for each partition of the writer, so this window and broadcast are bounded by their number
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(2)
        at = np.asarray(lists.offsets)
        flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        view = memoryview(flat.tobytes())
        crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digests(ids: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows as ``read_ids`` gives them."""
    return ids.select("doc_id", "start", "ids").mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, tokenizer: str | None = None, **how) -> DataFrame:
    """Write ``docs`` to a fresh folder of id files and return what they hold."""
    spark = docs.sparkSession
    out = fresh_path(spark, "ids")
    write_ids(docs, out, tokenizer or tokenizer_path(), **how)
    return digests(read_ids(spark, out))


def query(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
