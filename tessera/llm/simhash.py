"""Near-duplicate documents by SimHash, compared exactly tile by tile.

Distinct fingerprints are tiled by the population counts of their upper and
lower halves.  Two fingerprints within the radius differ by at most the radius
in population count, over any cut into parts, so only tiles whose counts are
that close are paired; inside a pair the same test over quarters skips most of
what is left.  What remains is compared by exclusive-or and bit counts in numpy.

Each tile pair returns a spanning forest of its links: every link's ends stay
connected and the number of edges is below the number of fingerprints, however
many copies there are.

``near_dedup`` links by Jaccard similarity.  Similar texts differ in so many of 64 bits
that fingerprints of ``WIDE`` bits are taken, of the distinct shingles, one vote each.  For
sets at the similarity each bit differs with a known chance (``worst``); the radius is
where such a pair lies beyond it with a chance of 1e-7.  Sizes of similar sets are in
the ratio of the similarity, so only tiles of neighbouring size classes are paired and all
pairs of sizes that allow a link are compared.  Tile pairs return spanning forests
of actual links, and each link is confirmed on the shingle sets (see ``jaccard``).

Defined cases: null and empty texts have no words and fingerprint zero, and
are linked like any other; texts of fewer words than a shingle give one
shingle; a null id is smaller than none, and only used where all ids of a
component are null; repeated rows share fingerprint and component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import SPACES, U64, Words, blocks, mix, text_buffers
from tessera.llm.components import components, forest, with_component
from tessera.llm.jaccard import SIMILARITY, shingle_sets, similar_components
from tessera.llm.jaccard import SHINGLE as SET_SHINGLE
from tessera.llm.keyed import ID, KEY, TEXT, free, key_of, keyed, matched
from tessera.llm.workspace import stage

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Fingerprints of a tile at most, on average, however they are distributed.
TILE = 1 << 20
#: Comparisons made at once.
STEP = 1 << 20
#: Bits of a wide fingerprint, its 64-bit lanes, and those compared first.
WIDE, LANES, FIRST = 256, 4, 2
_LANES = np.random.Generator(np.random.PCG64(7)).integers(0, 2**63, LANES, dtype=np.uint64)
#: Chance that a pair at the similarity lies beyond a radius.
MISS = 1e-7
#: Wide fingerprints of a tile, on average, and the rows and columns compared at once.
WIDE_TILE, ROWS, COLUMNS = 1 << 15, 16, 1 << 12
_WORDS = [f"w{k}" for k in range(LANES)]


def joined(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Words joined by single spaces, with each word's new span."""
    if not len(start):
        return b"", start, end
    size = end - start + 1
    stop = np.cumsum(size)
    out = np.full(int(stop[-1]), 32, np.uint8)
    begin = stop - size
    shift = np.repeat(start - begin, size - 1)
    to = np.arange(len(out), dtype=np.int64)
    inner = np.ones(len(out), bool)
    inner[stop - 1] = False
    to = to[inner]
    out[to] = raw[to + shift]
    return out[:-1].tobytes(), begin, stop - 1


def fingerprint(hashes: bytes) -> int:
    """Majority bits of concatenated big-endian 64-bit hashes, as a signed long."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(bits)).view(">i8")[0])


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_digest
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            out = []
            for a, b in blocks(offsets):
                words = Words(data, offsets[a : b + 1], SPACES, lower=True)
                text, start, end = joined(words.data, words.start, words.end)
                for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
                    if hi == lo:
                        out.append(0)
                        continue
                    k = min(shingle, hi - lo) - 1
                    spans = zip(start[lo : hi - k].tolist(), end[lo + k : hi].tolist(), strict=True)
                    out.append(fingerprint(b"".join([digest(text[s:e], seed) for s, e in spans])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.int64())], [ID, KEY, "fp"])

    return run


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _classes(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints sorted by quarter counts, where each class begins, and its counts."""
    quarter = _quarters(fp)
    code = quarter @ np.array([1, 17, 289, 4913], np.int32)
    order = np.argsort(code, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0])
    return fp[order], np.r_[at, len(fp)], quarter[order[at]]


def links(a: np.ndarray, b: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair within the radius, by blocks of at most about ``STEP`` comparisons."""
    a, at_a, count_a = _classes(a)
    b, at_b, count_b = _classes(b)
    for i in range(len(count_a)):
        near = np.flatnonzero(np.abs(count_b - count_a[i]).sum(1) <= radius)
        if not len(near):
            continue
        right = np.concatenate([b[at_b[j] : at_b[j + 1]] for j in near])
        rows = max(1, STEP // len(right))
        for k in range(at_a[i], at_a[i + 1], rows):
            left = a[k : min(k + rows, at_a[i + 1])]
            for m in range(0, len(right), STEP):
                part = right[m : m + STEP]
                x, y = np.nonzero(np.bitwise_count(left[:, None] ^ part[None, :]) <= radius)
                if len(x):
                    yield left[x], part[y]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1), strict=True):
                a, b = (x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (a, b))
                us, vs, n = [], [], 0
                for u, v in links(a, b, radius):
                    keep = u != v
                    us.append(u[keep]), vs.append(v[keep])
                    n += int(keep.sum())
                    if n > 4 * STEP:
                        u, v = forest(np.concatenate(us), np.concatenate(vs))
                        us, vs, n = [u], [v], len(u)
                if n:
                    u, v = forest(np.concatenate(us), np.concatenate(vs))
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    return run


def near_pairs(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) that connect the distinct fingerprints ``fp`` exactly as all links would."""
    distinct = stage(prints.select("fp").distinct(), "prints")
    chunks = 1 + distinct.count() // TILE
    high, low = F.bit_count(F.shiftrightunsigned("fp", 32)), F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    tiles = distinct.groupBy(high.alias("high"), low.alias("low"), F.pmod(F.xxhash64("fp"), F.lit(chunks)).alias("chunk")).agg(F.collect_list("fp").alias("tile"))
    reach = [(h, w) for h in range(radius + 1) for w in range(-radius, radius + 1) if h + abs(w) <= radius and (h, w) >= (0, 0)]
    offset = F.explode(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(w).alias("w")) for h, w in reach]))
    left = tiles.select("high", "low", "chunk", "tile", offset.alias("o")).select((F.col("high") + F.col("o.h")).alias("high"), (F.col("low") + F.col("o.w")).alias("low"), F.col("chunk").alias("c1"), F.col("tile").alias("a"), ((F.col("o.h") == 0) & (F.col("o.w") == 0)).alias("same"))
    pairs = left.join(tiles.withColumnRenamed("tile", "b"), ["high", "low"]).filter(~F.col("same") | (F.col("c1") <= F.col("chunk")))
    spread = pairs.select("a", "b", "high", "low", "c1", "chunk", F.size("a").alias("n")).repartition("high", "low", "c1", "chunk", "n")
    return spread.select("a", "b").mapInArrow(_compare(radius), "u long, v long")


def simhash(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """(id, key, fp, component): per row its fingerprint and the least id of its component."""
    base = keyed(docs, doc_id, text).select(ID, TEXT, KEY)
    prints = stage(base.mapInArrow(_fingerprints(shingle, seed), f"{ID} long, {KEY} long, fp long"), "fingerprints")
    root = components(near_pairs(prints, radius)).withColumnRenamed("node", "fp")
    return with_component(prints, root)


def differs(n: int, m: int, common: int) -> float:
    """Chance that a bit differs between majorities of ``n`` and ``m`` random votes of which ``common`` are shared."""

    def above(votes: int, least: int) -> float:
        return sum(math.comb(votes, k) for k in range(max(least, 0), votes + 1)) / 2**votes

    total = 0.0
    for k in range(common + 1):
        a, b = above(n - common, n // 2 + 1 - k), above(m - common, m // 2 + 1 - k)
        total += math.comb(common, k) / 2**common * (a * (1 - b) + b * (1 - a))
    return total


@cache
def worst(similarity: float, size: int = 1, upto: int = 40) -> float:
    """The greatest chance that a bit differs between unequal sets of ``size`` or more at the similarity.

    Beyond ``upto`` the chance falls towards that of normal votes, which is the least returned.
    """
    found = math.acos(2 * similarity / (1 + similarity)) / math.pi
    for n in range(size, upto + 1):
        for m in range(n, int(n / similarity + 1e-9) + 1):
            common = max(0, math.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
            if common <= n and (n, common) != (m, n):
                found = max(found, differs(n, m, common))
    return found


@cache
def reach(similarity: float, size: int, bits: int) -> int:
    """The radius beyond which a pair of sets of ``size`` or more at the similarity lies with a chance of ``MISS`` at most."""
    p = worst(similarity, min(size, 40))
    radius, beyond = bits, p**bits
    while beyond <= MISS:
        radius -= 1
        beyond += math.comb(bits, radius) * p**radius * (1 - p) ** (bits - radius)
    return radius


def wide(hashes: np.ndarray) -> np.ndarray:
    """Majority bits of distinct 64-bit hashes, each spread over ``WIDE`` bits, as lanes."""
    votes = np.zeros(WIDE, np.int64)
    for s in range(0, len(hashes), 255):
        votes += np.unpackbits(mix(hashes[s : s + 255, None] ^ _LANES).view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(hashes)).view(U64)


def _wide_prints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, size, lanes = [], [], np.zeros((len(batch), LANES), U64)
            for k, hashes in enumerate(shingle_sets(batch.column(1), shingle)):
                fp.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                size.append(len(hashes))
                lanes[k] = wide(hashes)
            columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in lanes.T]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(fp, U64).view(np.int64)), pa.array(size, pa.int32()), *columns], [ID, KEY, "fp", "n", *_WORDS])

    return run


def spanning(x: np.ndarray, y: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the links (x, y) those of a forest that joins what all join, the first ones where there is a choice, and the labels then."""
    kept = []
    while True:
        a, b = label[x], label[y]
        cross = np.flatnonzero(a != b)
        if not len(cross):
            break
        first = np.full(len(label), len(x))
        np.minimum.at(first, a[cross], cross)
        np.minimum.at(first, b[cross], cross)
        pick = np.unique(first[first < len(x)])
        kept.append(pick)
        now = np.arange(len(label))
        root, node = forest(a[pick], b[pick])
        now[node] = root
        label = now[label]
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    return x[kept], y[kept], label


def wide_links(n: np.ndarray, lanes: np.ndarray, m: np.ndarray, others: np.ndarray, same: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (place, place) that connect what all pairs within the radius connect, of sets that sizes ``n`` and ``m`` allow to be similar.

    Sizes ascend; ``lanes`` are the fingerprints of the sets of sizes ``n``, ``others`` those of ``m``, or the same.
    """
    tenths, shift = round(1000 * similarity), 0 if same else len(n)
    label = np.arange(len(n) + (0 if same else len(m)))
    radius, near = (reach(similarity, int(min(n[0], m[0])), bits) for bits in (WIDE, 64 * FIRST))
    found, held = [], 0

    def flush() -> tuple[np.ndarray, np.ndarray]:
        nonlocal label, held
        x, y, d = (np.concatenate(part) for part in zip(*found, strict=True))
        order = np.argsort(d, kind="stable")
        x, y, label = spanning(x[order], y[order], label)
        found.clear()
        held = 0
        return x, y - shift

    for i in range(0, len(n), ROWS):
        left = lanes[:, i : i + ROWS, None]
        low = np.searchsorted(m, -(-int(n[i]) * tenths // 1000))
        high = np.searchsorted(m, int(n[min(i + ROWS, len(n)) - 1]) * 1000 // tenths, "right")
        for j in range(max(low, i) if same else low, high, COLUMNS):
            right = others[:, None, j : min(j + COLUMNS, high)]
            d = np.bitwise_count(left[0] ^ right[0])
            for k in range(1, FIRST):
                d += np.bitwise_count(left[k] ^ right[k])
            x, y = np.divmod(np.flatnonzero(d <= near), d.shape[1])
            x, y = x + i, y + j
            keep = label[x] != label[y + shift]
            if same:
                keep &= x < y
            x, y = x[keep], y[keep]
            least, most = np.minimum(n[x], m[y]).astype(np.int64), np.maximum(n[x], m[y]).astype(np.int64)
            # unequal sets of one size share all but one element at most
            equal = least == most
            d = np.bitwise_count(lanes[:, x] ^ others[:, y]).sum(0, dtype=np.int64)
            keep = (d <= radius) & ((least - equal) * 1000 >= tenths * (most + equal))
            if keep.any():
                found.append((x[keep], y[keep] + shift, d[keep]))
                held += int(keep.sum())
                if held > STEP:
                    yield flush()
    if held:
        yield flush()


def _wide_compare(similarity: float):
    def unpacked(tile: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fp, n, *lanes = (tile.values.field(k).to_numpy(zero_copy_only=False) for k in range(2 + LANES))
        order = np.argsort(n, kind="stable")
        return fp[order], n[order], np.stack(lanes)[:, order].view(U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist(), strict=True):
                (u, n, lanes), (v, m, others) = unpacked(a), unpacked(b)
                if same:
                    v, m, others = u, n, lanes
                for x, y in wide_links(n, lanes, m, others, same, similarity):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u[x], v[y])), pa.array(np.minimum(u[x], v[y]))], ["u", "v"])

    return run


def wide_pairs(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links (u, v) that connect the sets ``nodes`` (fp, n, lanes) as all pairs of wide fingerprints within the radius would."""
    # a little wider than the ratio, so that rounding never puts similar sizes two classes apart
    width = math.log((1 + 1e-9) / similarity)
    classed = nodes.filter("n > 0").withColumn("class", F.floor(F.log(F.col("n")) / width))
    chunks = classed.groupBy("class").agg((1 + F.floor(F.count("*") / WIDE_TILE)).alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk")
    tiles = stage(classed.join(F.broadcast(chunks), "class").groupBy("class", chunk).agg(F.collect_list(F.struct("fp", "n", *_WORDS)).alias("tile")), "wide_tiles")
    left = tiles.select("class", F.col("chunk").alias("c1"), F.col("tile").alias("a"), F.explode(F.array(F.lit(0), F.lit(1))).alias("up")).withColumn("class", F.col("class") + F.col("up"))
    pairs = left.join(tiles.withColumnRenamed("tile", "b"), "class").filter("up = 1 or c1 <= chunk")
    spread = pairs.repartition("class", "up", "c1", "chunk")
    return spread.select("a", "b", F.expr("up = 0 and c1 = chunk").alias("same")).mapInArrow(_wide_compare(similarity), "u long, v long")


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SET_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, key, component): per row the least id of the documents it is linked to, over any number of links."""
    base = keyed(docs, doc_id, text).select(ID, TEXT, KEY)
    lanes = ", ".join(f"{w} long" for w in _WORDS)
    prints = stage(base.mapInArrow(_wide_prints(shingle), f"{ID} long, {KEY} long, fp long, n int, {lanes}"), "wide_prints")
    # one row of each shingle set, which all rows with that set agree with
    nodes = stage(prints.groupBy("fp").agg(F.min(F.struct(KEY, "n", *_WORDS)).alias("s")).select("fp", "s.*"), "wide_nodes")
    links = stage(wide_pairs(nodes, similarity).distinct(), "wide_links")
    family = components(links).select(F.col("node").alias("fp"), F.col("root").alias("family"))
    family = family.union(family.select("family", "family").distinct())
    members = stage(nodes.select("fp", KEY, "n").join(family, "fp"), "families")
    texts = base.select(TEXT, KEY).join(members.select(KEY).hint("shuffle_hash"), KEY, "left_semi")
    if prints.count() != prints.select(KEY).distinct().count():
        texts = texts.dropDuplicates([KEY])
    root = similar_components(members.drop(KEY), links, texts.select(TEXT), shingle, similarity)
    return with_component(prints.select(ID, KEY, "fp"), root.withColumnRenamed("node", "fp")).select(ID, KEY, "component")


def near_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that are the least of their component; of repeated rows one.

    Linked are rows whose wide SimHash fingerprints lie within the radius and whose
    five-word shingles have a Jaccard similarity of 0.8 or more.
    """
    found = stage(near_components(docs, doc_id, text, **how), "components")
    kept = found.filter(F.col(ID).eqNullSafe(F.col("component")))
    # of rows that share the least id one text stays; nulls stand together under a null component
    left = matched(docs, kept.groupBy("component").agg(F.min(KEY).alias(KEY)), "left_semi", doc_id, text)
    if found.count() != found.select(KEY).distinct().count():
        (key,) = free(docs, KEY)
        left = left.withColumn(key, key_of(doc_id, text)).dropDuplicates([key]).drop(key)
    return left


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return simhash(docs).select(F.col(ID).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
