"""Location columns: from names and comments, from the look of values, and clusters of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.expr import haversine_km, whole_match

# Words of location columns, in order; the last that fits wins.
LOCATION_WORDS = ("city", "zipcode", "town", "latitude", "longitude", "country", "address", "pincode", "street", "state", "nation")
LATITUDE = r"-?(?:[0-8]?[0-9](?:\.[0-9]+)?|90(?:\.0+)?)"
LONGITUDE = r"-?(?:(?:1[0-7][0-9]|[0-9]?[0-9])(?:\.[0-9]+)?|180(?:\.0+)?)"


def location_keyword(columns: DataFrame, name: str = "column_name", comment: str = "comment") -> DataFrame:
    """``columns`` with ``keyword``: the last location word that the name, or a word of the comment, contains or is contained in; null if none.

    Words of one letter or none say nothing."""
    words = F.array_append(F.split(F.coalesce(F.col(comment), F.lit("")), " "), F.col(name))
    words = F.filter(words, lambda w: F.length(w) > 1)

    def said(word: str) -> Column:
        return F.when(F.exists(words, lambda w: F.contains(w, F.lit(word)) | F.contains(F.lit(word), w)), word)

    fits = [said(k) for k in reversed(LOCATION_WORDS)]
    return columns.withColumn("keyword", F.coalesce(*fits))


def detect_coordinates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, kind): latitude where all values look like one, else longitude where all do, else null; nulls don't count."""
    wide = df.agg(*(x for c in columns for x in (F.count(c).alias(f"{c}|n"), F.count_if(whole_match(F.col(c), [LATITUDE])).alias(f"{c}|lat"), F.count_if(whole_match(F.col(c), [LONGITUDE])).alias(f"{c}|lon"))))
    rows = F.array(*(F.struct(F.lit(c).alias("column_name"), F.when(F.col(f"`{c}|n`") > 0, F.when(F.col(f"`{c}|lat`") == F.col(f"`{c}|n`"), "latitude").when(F.col(f"`{c}|lon`") == F.col(f"`{c}|n`"), "longitude")).alias("kind")) for c in columns))
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def points_near(centers: DataFrame, points: DataFrame, km: float = 100.0) -> DataFrame:
    """(id, near): how many points lie within ``km`` of each centre. A centre meets the points of the cells of latitude and longitude
    around it only; towards the poles, where degrees of longitude are short, these are more cells, up to a whole ring."""
    step = km / 111.0  # a degree of latitude is over 110 km
    many = max(1, int(360 / step))
    wide = 360.0 / many
    band = lambda lat: F.floor(lat / step)
    east = lambda lon: F.pmod(lon + 180.0, F.lit(360.0))
    reach = F.degrees(F.asin(F.sin(F.lit(km / 6300.0)) / F.cos(F.radians("lat")))) * 1.01
    cells = F.when(F.abs("lat") + 2 * step >= 90, F.sequence(F.lit(0).cast("bigint"), F.lit(many - 1).cast("bigint"))).otherwise(F.array_distinct(F.transform(F.sequence(F.floor((east(F.col("lon")) - reach) / wide), F.floor((east(F.col("lon")) + reach) / wide)), lambda x: F.pmod(x, F.lit(many)))))
    c = centers.select("id", F.col("lat").alias("clat"), F.col("lon").alias("clon"), F.explode(F.sequence(band(F.col("lat")) - 1, band(F.col("lat")) + 1)).alias("band"), cells.alias("cells"))
    c = c.select("id", "clat", "clon", "band", F.explode("cells").alias("cell"))
    p = points.select(F.col("lat").alias("plat"), F.col("lon").alias("plon"), band(F.col("lat")).alias("band"), F.least(F.floor(east(F.col("lon")) / wide), F.lit(many - 1)).alias("cell"))
    near = c.join(p, ["band", "cell"]).where(haversine_km(F.col("clat"), F.col("clon"), F.col("plat"), F.col("plon")) < km).groupBy("id").agg(F.count(F.lit(1)).alias("near"))
    return centers.select("id").join(near, "id", "left").fillna(0, ["near"])


def location_pairs(points: DataFrame, fine: str, coarse: str, n: int = 10) -> DataFrame:
    return points.groupBy(fine, coarse).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), fine, coarse).limit(n)


def cluster_points(points: DataFrame, k: int = 10, rounds: int = 10, seed: int = 1) -> DataFrame:
    """(cluster, lat, lon, size, cost): k-means centres, with the whole within-cluster squared error."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["lat", "lon"], outputCol="features", handleInvalid="skip").transform(points)
    model = KMeans(k=k, maxIter=rounds, seed=seed).fit(rows)
    spark = points.sparkSession
    centers = spark.createDataFrame([(i, float(c[0]), float(c[1])) for i, c in enumerate(model.clusterCenters())], "cluster int, lat double, lon double")
    sizes = model.transform(rows).groupBy(F.col("prediction").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return centers.join(sizes, "cluster", "left").fillna(0, ["size"]).withColumn("cost", F.lit(float(model.summary.trainingCost)))
