"""GPX files in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattspark.functions.geo import haversine

_POINT = "struct<_lat:double,_lon:double,ele:double>"
_TRACK = f"struct<trk:array<struct<name:string,trkseg:array<struct<trkpt:array<{_POINT}>>>>>,rte:array<struct<name:string,rtept:array<{_POINT}>>>>"
MOST_POINTS = 100_000
LEAST_STEP_METRES = 0.5


def parse(documents: DataFrame, text: str = "gpx", key: str = "path") -> DataFrame:
    """(key, idx, lat, lng, ele) of GPX documents: track points, or route points where there is no track.

    Points out of range go, heights outside -500..9000 m become null, points less than half a metre
    after the one before go, and of what remains the first MOST_POINTS stay.
    """
    x = F.from_xml(F.col(text), _TRACK, {"nullValue": "", "mode": "PERMISSIVE"})
    track = F.flatten(F.flatten(F.transform(F.col("x.trk"), lambda t: F.transform(F.coalesce(t["trkseg"], F.array()), lambda s: F.coalesce(s["trkpt"], F.array())))))
    route = F.flatten(F.transform(F.col("x.rte"), lambda r: F.coalesce(r["rtept"], F.array())))
    rows = documents.select(key, x.alias("x")).withColumn("points", F.when(F.size(track) > 0, track).otherwise(route))
    each = rows.select(key, F.posexplode("points").alias("pos", "p")).select(key, "pos", F.col("p._lat").alias("lat"), F.col("p._lon").alias("lng"), F.col("p.ele").alias("ele"))
    good = each.filter(F.col("lat").between(-90, 90) & F.col("lng").between(-180, 180)).withColumn("ele", F.when(F.col("ele").between(-500, 9000), F.col("ele")))
    w = Window.partitionBy(key).orderBy("pos")
    step = haversine(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    kept = good.withColumn("step", step).filter(F.col("step").isNull() | (F.col("step") >= LEAST_STEP_METRES))
    return kept.withColumn("idx", F.row_number().over(w) - 1).filter(F.col("idx") < MOST_POINTS).select(key, "idx", "lat", "lng", "ele")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The points of all GPX files under a path, one file a document."""
    files = spark.read.option("pathGlobFilter", "*.gpx").option("recursiveFileLookup", "true").format("binaryFile").load(path)
    return parse(files.select("path", F.decode("content", "UTF-8").alias("gpx")))


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def build(tracks: DataFrame, name: str = "name", points: str = "track") -> DataFrame:
    """`tracks` with a column gpx; the track is array<struct<lat,lng,ele>>."""
    number = lambda c: F.regexp_replace(F.format_string("%.6f", c), "0+$", "")
    point = lambda p: F.concat(F.lit('<trkpt lat="'), number(p["lat"]), F.lit('" lon="'), number(p["lng"]), F.lit('">'), F.when(p["ele"].isNotNull(), F.concat(F.lit("<ele>"), number(p["ele"]), F.lit("</ele>"))).otherwise(""), F.lit("</trkpt>"))
    body = F.array_join(F.transform(points, point), "")
    head = '<?xml version="1.0" encoding="UTF-8"?><gpx version="1.1" creator="wattspark" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'
    return tracks.withColumn("gpx", F.concat(F.lit(head), _escaped(F.col(name)), F.lit("</name><trkseg>"), body, F.lit("</trkseg></trk></gpx>")))
