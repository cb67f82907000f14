"""Neighbours, clusters and bounds of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import exprs as E


def centroids(df: DataFrame) -> DataFrame:
    """(geohash, latitude, longitude) of the distinct cells."""
    cells = df.groupBy("geohash").agg(F.count("*").alias("n"))
    return cells.select("geohash", E.geohash_lat("geohash").alias("latitude"), E.geohash_lon("geohash").alias("longitude"), "n")


def knn_edges(cells: DataFrame, k: int = 5) -> DataFrame:
    """(geohash, nbr, rank, dist) by haversine distance, ties by name.

    Cells are few (one row for each place, not for each observation).
    """
    a = cells.select("geohash", "latitude", "longitude")
    b = cells.select(F.col("geohash").alias("nbr"), F.col("latitude").alias("lat2"), F.col("longitude").alias("lon2"))
    pairs = a.join(b, F.col("geohash") != F.col("nbr")).withColumn("dist", F.round(E.haversine("latitude", "longitude", "lat2", "lon2"), 12))
    rank = F.row_number().over(Window.partitionBy("geohash").orderBy("dist", "nbr"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("geohash", "nbr", "rank", "dist")


def knn_lag(df: DataFrame, ref: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean and population deviation of the neighbours' slot means yesterday at the same slot."""
    slots = ref.groupBy(F.col("geohash").alias("nbr"), (F.col("day") + 1).alias("day"), "time_slot").agg(F.avg("demand").alias("v"))
    seen = edges.select("geohash", "nbr").join(slots, "nbr").groupBy("geohash", "day", "time_slot").agg(F.avg("v").alias("knn_lag96_mean"), F.stddev_pop("v").alias("knn_lag96_std"))
    return df.join(seen, ["geohash", "day", "time_slot"], "left")


def nearest_center(df: DataFrame, centers: DataFrame) -> DataFrame:
    """spatial_cluster and dist_to_centroid (degrees), from (cluster, clat, clon).

    The centres, a handful of rows, become part of the expression, so no join is needed.
    """
    lat, lon = F.col("latitude"), F.col("longitude")
    away = [F.struct(F.sqrt(F.pow(lat - r["clat"], 2) + F.pow(lon - r["clon"], 2)).alias("d"), F.lit(r["cluster"]).alias("cluster")) for r in centers.collect()]
    best = F.when(lat.isNotNull() & lon.isNotNull(), F.array_min(F.array(*away)))
    return df.withColumn("_b", best).withColumns({"spatial_cluster": F.col("_b.cluster"), "dist_to_centroid": F.col("_b.d")}).drop("_b")


def kmeans_centers(cells: DataFrame, k: int = 6, seed: int = 42) -> DataFrame:
    """(cluster, clat, clon), numbered by latitude and longitude; distinct cells weighted by their rows."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    points = VectorAssembler(inputCols=["latitude", "longitude"], outputCol="x").transform(cells.dropna(subset=["latitude", "longitude"]))
    k = min(k, points.count())
    model = KMeans(k=k, seed=seed, featuresCol="x", weightCol="n").fit(points)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(sorted((c[0], c[1]) for c in model.clusterCenters()))]
    return cells.sparkSession.createDataFrame(rows, "cluster int, clat double, clon double")


def bounds(df: DataFrame, fence=((12.0, 14.0), (77.0, 78.5))) -> DataFrame:
    """Bounding box, and whether its lower corner lies in the fence."""
    box = df.agg(F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"))
    return box.withColumn("in_fence", F.col("min_lat").between(*fence[0]) & F.col("min_lon").between(*fence[1]))
