"""Connected components of an edge table by alternating large and small stars.

Every round is written to the shared folder, so lineage stays short and a lost
executor re-reads a table.  Edges never leave the executors; the driver sees
two numbers a round.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.keyed import ID, KEY
from tessera.llm.workspace import stage


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (root, node) with the same components as the links (u, v)."""
    nodes, flat = np.unique(np.r_[u, v], return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            break
        label = now
    move = label != np.arange(len(nodes))
    return nodes[label[move]], nodes[move]


#: Tasks over which the rows of one key are dealt.
SALTS = 16
_SALT = "__salt"


def attach_least(rows: DataFrame, key: str, value: str, name: str, *dealt_by: str) -> DataFrame:
    """``rows`` with the least ``value`` of their ``key``; the rows of a hot key are dealt over ``SALTS`` tasks.

    A key's least value travels once to each of the tasks that hold its rows.
    """
    salted = rows.withColumn(_SALT, F.pmod(F.xxhash64(*dealt_by), F.lit(SALTS)).cast("int"))
    parts = salted.groupBy(key, _SALT).agg(F.min(value).alias(name))
    least = parts.groupBy(key).agg(F.min(name).alias(name), F.collect_list(_SALT).alias("salts")).select(key, name, F.explode("salts").alias(_SALT))
    return salted.join(least, [key, _SALT]).drop(_SALT)


def _round(edges: DataFrame) -> DataFrame:
    """One large star, then one small star, over edges (u, v) with u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = attach_least(both, "u", "v", "m", "v").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
    small = attach_least(large, "u", "v", "m", "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node reachable.  Nodes without an edge are absent."""
    now = stage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    before = None
    while True:
        now = stage(_round(now), "edges")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def with_component(prints: DataFrame, root: DataFrame) -> DataFrame:
    """``prints`` (id, key, fp, ...) with the least id of their fingerprint's component, from ``root`` (fp, root).

    Rows of one fingerprint, and fingerprints of one root, are dealt over several tasks.
    """
    salted = prints.withColumn(_SALT, F.pmod(F.xxhash64(ID, KEY), F.lit(SALTS)).cast("int"))
    spots = salted.groupBy("fp", _SALT).agg(F.min(ID).alias("least"))
    rooted = spots.groupBy("fp").agg(F.min("least").alias("least")).join(root, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = attach_least(rooted, "root", "least", "component", "fp").select("fp", "component")
    return salted.join(spots.select("fp", _SALT).join(named, "fp"), ["fp", _SALT]).drop(_SALT)
