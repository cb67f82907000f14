"""Mixing of sources to target sizes by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents should have; the whole part is taken, and the fractions are rounded
together: two fractional documents meet, and a random transfer of mass between
them (in words, so that their sum is kept) makes one of them whole.  Each keeps
its expectation, and a source's total ends within one document of its target.

The meetings form a reduction tree.  Documents are hashed into leaves of about
``FAN_IN``, each leaf is folded natively to at most one fractional residual,
and the residuals are the next level's documents.  The number of levels is the
logarithm of the largest source, and no leaf grows with a source's size.

Everything is DataFrame functions; random numbers are hashes of ids, level and
seed, so reruns agree.

Defined cases: null texts have size 0 and are never taken; a null source is a
source of its own, ordered last; rows equal in id, text and source share one
fate; with all sizes 0 every target is 0; no rows give no rows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.keyed import ID, KEY, free, key_of
from tessera.llm.native import count_words, let, uniform
from tessera.llm.workspace import stage

WEIGHTS, SHARE, CAP = (3.0, 1.0, 2.0), 1.5, 2.0
FAN_IN = 64
SEED = 42
_EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above its cap.

    The windows without a key hold one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = (F.row_number().over(order) - 1) % len(weights)
    whole = Window.partitionBy()
    w = F.get(F.array(*map(F.lit, weights)), nth.cast("int"))
    s = sizes.select("source", "source_size", w.alias("w")).withColumn("c", cap * F.col("source_size"))
    by = Window.orderBy(F.col("c") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("*", F.coalesce(F.sum("c").over(by), F.lit(0.0)).alias("c_before"), F.coalesce(F.sum("w").over(by), F.lit(0.0)).alias("w_before"), F.sum("w").over(whole).alias("w_all"), (share * F.sum("source_size").over(whole)).alias("total"))
    # the level at which this source and all of larger cap stand uncapped
    s = s.withColumn("level", (F.col("total") - F.col("c_before")) / (F.col("w_all") - F.col("w_before")))
    open_ = F.when(F.col("level") * F.col("w") <= F.col("c"), F.col("level"))
    s = s.withColumn("final", F.min(F.when(open_.isNotNull(), F.struct("w_before", open_.alias("level")))).over(whole)["level"])
    return s.select("source", "source_size", F.least(F.col("c"), F.coalesce(F.col("final") * F.col("w"), F.col("c"))).alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Settle a leaf: struct(out: decided units, c: the residual unit or null)."""
    none = F.lit(None).cast("struct<id:bigint,key:bigint,a:double,p:double>")
    empty = F.array().cast("array<struct<id:bigint,key:bigint,a:double,p:double>>")
    unit = lambda x, p: F.struct(x["id"].alias("id"), x["key"].alias("key"), x["a"].alias("a"), p.alias("p"))

    def meet(acc: Column, x: Column) -> Column:
        c = acc["c"]
        gain, loss = F.least((1 - c["p"]) * c["a"], x["p"] * x["a"]), F.least(c["p"] * c["a"], (1 - x["p"]) * x["a"])

        def moved(m: Column) -> Column:
            up = m["u"] * (m["gain"] + m["loss"]) < m["loss"]
            mass = F.when(up, m["gain"]).otherwise(-m["loss"])

            def placed(z: Column) -> Column:
                whole = lambda p: (p < _EPS) | (p > 1 - _EPS)
                left, right = unit(c, z["pc"]), unit(x, z["px"])
                return (
                    F.when(whole(z["pc"]) & whole(z["px"]), F.struct(F.concat(acc["out"], F.array(left, right)).alias("out"), none.alias("c")))
                    .when(whole(z["pc"]), F.struct(F.concat(acc["out"], F.array(left)).alias("out"), right.alias("c")))
                    .otherwise(F.struct(F.concat(acc["out"], F.array(right)).alias("out"), left.alias("c")))
                )

            return let(F.struct((c["p"] + mass / c["a"]).alias("pc"), (x["p"] - mass / x["a"]).alias("px")), placed)

        met = let(F.struct(gain.alias("gain"), loss.alias("loss"), uniform(F.lit(seed), F.lit(level), c["key"], x["key"]).alias("u")), moved)
        return F.when(c.isNull(), F.struct(acc["out"].alias("out"), unit(x, x["p"]).alias("c"))).otherwise(met)

    return F.aggregate(F.array_sort(units), F.struct(empty.alias("out"), none.alias("c")), meet)


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """(id, key, source, n_rows, size, source_size, target, copies): one row for each distinct row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias(ID), F.xxhash64(F.col(doc_id).cast("long"), body).alias(KEY), F.col(source).cast("string").alias("source"), count_words(body).alias("size"))
    units = stage(rows.groupBy(ID, KEY, "source").agg(F.max("size").alias("size"), F.count("*").alias("n_rows")), "units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n_units"))
    sizes = stage(sizes, "sizes")  # a row for each source
    most = sizes.agg(F.max("n_units")).first()[0] or 0
    aims = stage(targets(sizes, weights, share, cap), "targets").join(sizes.select(F.col("source").alias("source_"), "n_units"), F.col("source").eqNullSafe(F.col("source_"))).select("source_", "n_units", "source_size", "target")
    each = units.join(aims, F.col("source").eqNullSafe(F.col("source_")), "left").drop("source_")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    near = F.round(copies)
    each = each.withColumn("f", F.when(F.abs(copies - near) < _EPS, near).otherwise(copies))
    each = stage(each.withColumn("whole", F.floor("f")).withColumn("p", F.when(F.col("size") > 0, F.col("f") - F.floor("f")).otherwise(0.0)), "fractions")

    left = each.filter("p > 0").select("source", "n_units", F.struct(F.col(ID).alias("id"), F.col(KEY).alias("key"), (F.col("size") * F.col("n_rows")).cast("double").alias("a"), "p").alias("unit"))
    decided = None
    levels = max(1, ceil(log(max(most, 2)) / log(FAN_IN)))
    leaves = F.col("n_units").cast("double")
    for level in range(levels + 1):
        leaves = F.ceil(leaves / FAN_IN)
        leaf = F.pmod(F.xxhash64(F.lit(seed + 1 + level), F.col("unit.key")), F.greatest(leaves, F.lit(1)).cast("long"))
        # past the last level each source is one leaf
        leaf = F.lit(0).cast("long") if level == levels else leaf
        folded = stage(left.groupBy("source", "n_units", leaf.alias("leaf")).agg(F.collect_list("unit").alias("units")).select("source", "n_units", _fold(F.col("units"), level, seed).alias("r")), "leaves")
        out = folded.select("source", F.explode("r.out").alias("u")).select("source", "u.*")
        left = folded.filter(F.col("r.c").isNotNull()).select("source", "n_units", F.col("r.c").alias("unit"))
        decided = out if decided is None else decided.union(out)
    last = left.select("source", "unit.*").withColumn("p", (uniform(F.lit(seed), F.col("key")) < F.col("p")).cast("double"))
    decided = decided.union(last).select("key", F.col("id").alias("id_"), F.col("source").alias("source_"), (F.col("p") > 0.5).cast("long").alias("up"))
    on = (F.col(KEY) == F.col("key")) & F.col("source").eqNullSafe(F.col("source_")) & F.col(ID).eqNullSafe(F.col("id_"))
    return each.join(decided, on, "left").select(ID, KEY, "source", "n_rows", "size", "source_size", F.col("target"), F.when(F.col("size") > 0, F.col("whole").cast("long") + F.coalesce("up", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("copies"))


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    key, same, from_, copies, nth = free(docs, KEY, "__same", "__from", "__copies", "__nth")
    taken = mix(docs, doc_id, text, source, **how).filter("copies > 0").select(F.col(KEY).alias(same), F.col("source").alias(from_), F.col("copies").alias(copies))
    own = docs.withColumn(key, key_of(doc_id, text))
    joined = own.join(taken.hint("shuffle_hash"), (F.col(key) == F.col(same)) & F.col(source).cast("string").eqNullSafe(F.col(from_)))
    return joined.withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), copies))).drop(key, same, from_, copies, nth)


def query(spark, sf_dir: str) -> DataFrame:
    found = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    rows = found.withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "n_rows")))
    return rows.select(F.col(ID).alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
