"""Families of documents split by the Jaccard similarity of their word shingles.

The exact check behind the SimHash search of ``simhash``.  Equal shingle sets are one
node; a family is a component of SimHash links.  Every SimHash link is confirmed on the
whole shingle sets, so no pair below the similarity is ever linked.

A family whose nodes are then still in several components is searched exactly: its nodes
outside its largest component are compared with all its nodes, over the whole shingle
sets, in tiles of bounded size, and only the links that are found leave a task, as a
spanning forest.  So the components of a family are those of all its links.

Defined cases: words as in ``simhash``; texts of fewer words than a shingle
give one shingle; texts without words share one empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytescan import SPACES, U64, Words, blocks, mix, text_buffers
from tessera.llm.components import components, forest
from tessera.llm.workspace import stage

SHINGLE, SIMILARITY = 5, 0.8
_PLACES = np.random.Generator(np.random.PCG64(42)).integers(1, 2**63, 64, dtype=np.uint64) * U64(2) + U64(1)
#: Hashes of a tile.
TILE = 1 << 17


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """Of every text the sorted distinct hashes of its shingles."""
    data, offsets = text_buffers(column)
    for a, b in blocks(offsets):
        words = Words(data, offsets[a : b + 1], SPACES, lower=True)
        codes = words.codes()
        for lo, hi in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            k = min(shingle, hi - lo)
            if not k:
                yield np.zeros(0, U64)
                continue
            total = np.full(hi - lo - k + 1, U64(k))
            for p in range(k):
                total = mix(total) + codes[lo + p : hi - k + 1 + p] * _PLACES[p % 64]
            yield np.unique(mix(total))


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                rows = [(xxhash.xxh64_intdigest(b), b) for b in (h.tobytes() for h in shingle_sets(part.column(0), shingle))]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([f for f, _ in rows], U64).view(np.int64)), pa.array([b for _, b in rows], pa.binary())], ["fp", "hashes"])

    return run


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity, decided without rounding for tenths of per cents."""
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 1000 * common >= round(1000 * similarity) * (len(both) - common)


def _confirm(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(a.as_buffer(), U64), np.frombuffer(b.as_buffer(), U64), similarity) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def common_with(hashes: np.ndarray, keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of a set's hashes each of ``n`` sets holds; ``keys`` are all their hashes, sorted, with their owners."""
    low, high = np.searchsorted(keys, hashes, "left"), np.searchsorted(keys, hashes, "right")
    size = high - low
    stop = np.cumsum(size)
    spots = np.repeat(low - (stop - size), size) + np.arange(int(size.sum()))
    return np.bincount(owner[spots], minlength=n)


def _search(similarity: float):
    """Links between the outsiders of a tile and the nodes of another that are in other components."""
    tenths = round(1000 * similarity)

    def unpacked(nodes: pa.Scalar) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        fp, root = (nodes.values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        return fp, root, [np.frombuffer(x.as_buffer(), U64) for x in nodes.values.field(2)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1), strict=True):
                fp_a, root_a, sets_a = unpacked(left)
                fp_b, root_b, sets_b = unpacked(right)
                size = np.array([len(x) for x in sets_b])
                flat = np.concatenate(sets_b)
                order = np.argsort(flat, kind="stable")
                keys, owner = flat[order], np.repeat(np.arange(len(size)), size)[order]
                us, vs = [], []
                for fp, root, hashes in zip(fp_a, root_a, sets_a, strict=True):
                    common = common_with(hashes, keys, owner, len(size))
                    hit = (1000 * common >= tenths * (len(hashes) + size - common)) & (root_b != root)
                    us.append(np.full(int(hit.sum()), fp)), vs.append(fp_b[hit])
                u, v = np.concatenate(us), np.concatenate(vs)
                if len(u):
                    u, v = forest(u, v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], ["u", "v"])

    return run


def _searched(named: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) across the components of every family of (family, fp, n, root) that has several.

    A family of two has one pair, which its SimHash link compared.  A tile's share
    of a family is drawn by hash, for about ``TILE`` hashes.
    """
    roots = named.groupBy("family", "root").agg(F.count("*").alias("size"), F.sum("n").alias("hashes"))
    families = roots.groupBy("family").agg(F.count("*").alias("roots"), F.sum("size").alias("size"), F.max_by("root", F.struct("size", "root")).alias("main"), F.sum("hashes").alias("hashes")).filter("roots > 1 and size > 2")
    chunks = (1 + F.floor(F.col("hashes") / TILE)).cast("int")
    nodes = named.join(families.select("family", "main", chunks.alias("chunks")), "family").join(sets, "fp")
    nodes = nodes.select("family", "chunks", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int").alias("chunk"), (F.col("root") != F.col("main")).alias("outside"), F.struct("fp", "root", "hashes").alias("node"))
    tiles = nodes.groupBy("family", "chunks", "chunk").agg(F.collect_list(F.when(F.col("outside"), F.col("node"))).alias("outsiders"), F.collect_list("node").alias("tile"))
    tiles = stage(tiles, "shingle_tiles")
    left = tiles.filter(F.size("outsiders") > 0).select("family", "outsiders", F.col("chunk").alias("from"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    pairs = left.join(tiles.select("family", "chunk", "tile"), ["family", "chunk"]).repartition("family", "from", "chunk")
    return pairs.select("outsiders", "tile").mapInArrow(_search(similarity), "u long, v long")


def similar_components(members: DataFrame, links: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """(node, root) of the links of similar sets, for ``members`` (fp, n, family), their ``links`` (u, v) and a text of each in column 0."""
    sets = stage(texts.mapInArrow(_sets(shingle), "fp long, hashes binary"), "shingle_sets")
    u, v = (sets.select(F.col("fp").alias(k), F.col("hashes").alias(f"of_{k}")) for k in "uv")
    first = stage(links.join(u, "u").join(v, "v").select("u", "v", "of_u", "of_v").mapInArrow(_confirm(similarity), "u long, v long"), "shingle_links")
    named = members.join(components(first).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    more = stage(_searched(named, sets, similarity), "shingle_links")
    return components(first.union(more))
