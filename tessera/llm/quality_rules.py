"""Rejection of documents by base rules and robust multivariate outliers.

Base statistics are counted in each text.  Five transformed statistics make a
vector; for each language and source its centre and scatter are estimated by
minimum covariance determinant, and documents whose squared Mahalanobis
distance exceeds ``CUTOFF`` are rejected.

The estimate starts twice, from medians and quartile ranges and from the moments
of all, and each start takes concentration steps: the ``SHARE`` of a group's
documents nearest to the present centre give the next centre and scatter, whose
determinant does not grow.  Of a group's two results the one of less determinant
stays.  The share is cut off by a histogram of log distance, so no group is ever
sorted or gathered; sums and quartiles are of integers (the statistics in
thousandths, whose distinct values are bounded), so results do not depend on the
order of rows.  Scatters of small groups are drawn towards the pooled one by
``PRIOR`` documents' weight, and variances have a floor.

``CUTOFF`` lies far beyond the normal case's quantiles (20.5 for 0.999): the
statistics of fair documents have long tails, and only documents unlike all
others of their group should go.

Everything is DataFrame functions; the text is read once.

Defined cases: null texts have no words and fail the base rules; null language
or source is a group of its own; a group without documents that pass the base
rules judges nothing; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.keyed import ID, KEY, matched
from tessera.llm.native import let, space_words
from tessera.llm.workspace import stage

SYMBOLS = "#*$%&|<>"
RUN = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
SHARE, STEPS, PRIOR = 0.75, 3, 30.0
#: Smallest standard deviations, in the units of the transformed statistics.
FLOORS = (0.15, 0.05, 0.25, 0.25, 0.6)
#: Squared distance beyond which a document is rejected.
CUTOFF = 100.0
SCALE, P = 1000, 5
_BINS = 64
_G = ["lang", "source"]
_GS = [*_G, "start"]


def _chi_square(x: float, k: int) -> float:
    """The chi-square distribution function of k degrees of freedom, by its series."""
    a, x = k / 2, x / 2
    term = total = exp(a * log(x) - x - lgamma(a + 1))
    n = 0
    while term > 1e-16 * total:
        n += 1
        term *= x / (a + n)
        total += term
    return total


def consistency(share: float = SHARE, p: int = P) -> float:
    """How much larger the scatter of all is than that of the nearest ``share``, in the normal case."""
    low, high = 1e-9, 200.0
    while high - low > 1e-12:
        middle = (low + high) / 2
        low, high = (middle, high) if _chi_square(middle, p) < share else (low, middle)
    return share / _chi_square(low, p + 2)


def _repeat_words(words: Column) -> Column:
    """Words in RUN-word windows whose words occur twice or more in the text."""

    def body(h: Column) -> Column:
        n = F.size(h) - (RUN - 1)
        runs = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(RUN)]))

        def covered(r: Column) -> Column:
            pairs = F.array_sort(F.transform(r, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))

            def repeated(s: Column) -> Column:
                twice = lambda e, k: F.coalesce(F.get(s, k - 1)["x"] == e["x"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["x"] == e["x"], F.lit(False))
                at = F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"]))
                grown = lambda a: F.aggregate(a, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda acc, i: F.struct((i + RUN).alias("end"), (acc["n"] + F.least(F.lit(RUN), i + RUN - acc["end"])).alias("n")), lambda acc: acc["n"])
                return let(at, grown)

            return F.when(F.size(F.array_distinct(r)) == F.size(r), 0).otherwise(let(pairs, repeated))

        return F.when(n < 2, 0).otherwise(let(runs, covered))

    return let(F.transform(words, lambda w: F.xxhash64(w)), body)


def base_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(id, key, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias(ID), body.alias("t"), F.xxhash64(F.col(doc_id).cast("long"), body).alias(KEY), F.col(lang).alias("lang"), F.col(source).alias("source"))
    bare = F.translate("t", " \t\n\x0b\x0c\r", "")
    lines = F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    counted = rows.select(
        ID, KEY, *_G,
        let(space_words(F.col("t")), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.when(F.instr("t", "\n") == 0, 0).otherwise(let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))).cast("long").alias("n_dup_lines"),
    )
    n, r = F.col("w.n").cast("long"), F.col("w.r").cast("long")
    failed = (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)
    return counted.select(ID, KEY, *_G, n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", r.alias("n_repeat_words"), failed.alias("base_failed"))


def _vector() -> list[Column]:
    """The transformed statistics in thousandths, as long integers."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    per_cent = lambda c: F.log1p(100.0 * F.col(c) / n)
    x = [F.log1p(F.col("n_words").cast("double")), F.log(F.greatest(F.col("word_chars") / n, F.lit(1.0))), per_cent("n_symbols"), per_cent("n_dup_lines"), per_cent("n_repeat_words")]
    return [F.round(v * SCALE).cast("long").alias(f"x{i}") for i, v in enumerate(x)]


def _moments(rows: DataFrame) -> DataFrame:
    """Per group the count, sums and sums of products."""
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in range(P)]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(P) for j in range(i + 1)]
    return rows.groupBy(*_GS).agg(F.count("*").alias("n"), *sums, *products)


def _fit(moments: DataFrame) -> DataFrame:
    """Per group and start the centre, the inverse Cholesky factor of its scatter, drawn towards the pooled scatter, and its log determinant."""
    everything = Window.partitionBy("start")  # one row for each group
    d = moments
    names = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i in range(P) for j in range(i + 1)]
    d = d.select(*_GS, "n", *names, F.sum("n").over(everything).alias("n_all"), *[F.sum(F.col(c).cast("decimal(38,0)")).over(everything).cast("double").alias("all_" + c) for c in names])
    d = d.select(*_GS, "n", *names, "n_all", *["all_" + c for c in names], *[((F.col(f"s{i}") + PRIOR * F.col(f"all_s{i}") / F.col("n_all")) / (F.col("n") + PRIOR)).alias(f"m{i}") for i in range(P)])
    cov = []
    for i in range(P):
        for j in range(i + 1):
            own = F.col(f"q{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}").cast("double") / F.col("n")
            pooled = F.col(f"all_q{i}{j}") / F.col("n_all") - (F.col(f"all_s{i}") / F.col("n_all")) * (F.col(f"all_s{j}") / F.col("n_all"))
            value = consistency() * (own + PRIOR * pooled) / (F.col("n") + PRIOR)
            if i == j:
                value = F.greatest(value, F.lit(0.0)) + (FLOORS[i] * SCALE) ** 2
            cov.append(value.alias(f"c{i}{j}"))
    d = d.select(*_GS, *[f"m{i}" for i in range(P)], *cov)
    keep = [*_GS, *[f"m{i}" for i in range(P)]]
    # Cholesky factor, one row of it a projection
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            d = d.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1.0))) if i == j else rest / F.col(f"l{j}{j}"))
    # its inverse
    for i in range(P):
        for j in range(i + 1):
            if i == j:
                value = 1.0 / F.col(f"l{i}{i}")
            else:
                total = F.col(f"l{i}{j}") * F.col(f"w{j}{j}")
                for k in range(j + 1, i):
                    total = total + F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
                value = -total / F.col(f"l{i}{i}")
            d = d.withColumn(f"w{i}{j}", value)
    return d.select(*keep, *[f"w{i}{j}" for i in range(P) for j in range(i + 1)], sum((2 * F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)).alias("log_det"))


def _distance() -> Column:
    total = F.lit(0.0)
    for i in range(P):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"w{i}{j}") * (F.col(f"x{j}") - F.col(f"m{j}"))
        total = total + y * y
    return total


def _same_group(*columns: str) -> Column:
    on = F.lit(True)
    for c in columns:
        on = on & F.col(c).eqNullSafe(F.col(c + "_"))
    return on


def _judged(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """Rows with their squared distance, under each start of the fit; it has a row or two a group, and Spark decides by its size how to join."""
    named = fit.withColumnsRenamed({c: c + "_" for c in _G}).drop("log_det")
    more = ["start"] if "start" in fit.columns else []
    return rows.join(named, _same_group(*_G), "left").select(*rows.columns, *more, _distance().alias("d2"))


def _nearest(judged: DataFrame) -> DataFrame:
    """The SHARE of each group with least distance, to a bin of the histogram of log distance."""
    binned = judged.withColumn("bin", F.floor(F.log1p("d2") * _BINS).cast("int"))
    counts = binned.groupBy(*_GS, "bin").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*_GS)  # as many rows as bins
    upto = counts.select(*_GS, "bin", F.sum("n").over(group.orderBy("bin")).alias("upto"), F.sum("n").over(group).alias("all"))
    limit = upto.filter(F.col("upto") >= SHARE * F.col("all")).groupBy(*[F.col(c).alias(c + "_") for c in _GS]).agg(F.min("bin").alias("limit"))
    return binned.join(limit, _same_group(*_GS) & (F.col("bin") <= F.col("limit"))).select(*judged.columns)


def _starts(rows: DataFrame) -> DataFrame:
    """First fits: 0 has medians as centre, quartile ranges as spread and no correlation; 1 the moments of all."""
    parts = rows.groupBy(*_G).agg(*[F.percentile(f"x{i}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(P)])
    spread = [1.0 / F.sqrt(((F.get(f"p{i}", F.lit(2)) - F.get(f"p{i}", F.lit(0))) / 1.349) ** 2 + (FLOORS[i] * SCALE) ** 2) for i in range(P)]
    robust = parts.select(*_G, F.lit(0).alias("start"), *[F.get(f"p{i}", F.lit(1)).cast("double").alias(f"m{i}") for i in range(P)], *[(spread[i] if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i in range(P) for j in range(i + 1)], F.lit(0.0).alias("log_det"))
    return robust.unionByName(_fit(_moments(rows.withColumn("start", F.lit(1)))))


def estimate(rows: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per group of vectors (lang, source, x0, ...) the centre and inverse Cholesky factor of least determinant."""
    fit = stage(_starts(rows), "fit")
    for _ in range(steps):
        fit = stage(_fit(_moments(_nearest(_judged(rows, fit)))), "fit")
    least = fit.groupBy(*_G).agg(F.min(F.struct("log_det", "start", *[c for c in fit.columns if c not in (*_GS, "log_det")])).alias("f"))
    return least.select(*_G, "f.*").drop("start")


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", steps: int = STEPS, cutoff: float = CUTOFF) -> DataFrame:
    """(id, key, statistics, base_failed, d2, kept) of every row."""
    counted = stage(base_statistics(docs, doc_id, text, lang, source).select("*", *_vector()), "statistics")
    fair = counted.filter(~F.col("base_failed")).select(*_G, *[f"x{i}" for i in range(P)])
    judged = _judged(counted, estimate(fair, steps))
    return judged.drop(*[f"x{i}" for i in range(P)]).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True)))


def apply_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that the rules keep."""
    return matched(docs, quality_rules(docs, doc_id, text, **how).filter("kept"), "left_semi", doc_id, text)


def query(spark, sf_dir: str) -> DataFrame:
    found = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col(ID).alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("d2", 6).alias("distance2"))
