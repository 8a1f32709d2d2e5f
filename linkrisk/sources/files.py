"""Sources: delimited tables, GeoJSON, Parquet, yearly templates, and a file inventory."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rates
from ..operators.gates import require_columns
from . import ranges

#: Bytes up to which a file may be one value.
WHOLE = 64 << 20

COLLISION_TYPES: Mapping[str, str] = {
    "collision_index": "string", "collision_year": "int", "longitude": "double", "latitude": "double", "collision_severity": "int",
    "number_of_vehicles": "int", "number_of_casualties": "int", "date": "string", "time": "string", "speed_limit": "int",
    "local_authority_highway_current": "string",
}
TRAFFIC_TYPES: Mapping[str, str] = {
    "count_point_id": "long", "year": "int", "region_id": "int", "region_name": "string", "region_ons_code": "string", "local_authority_id": "int",
    "local_authority_name": "string", "local_authority_code": "string", "road_name": "string", "road_category": "string", "road_type": "string",
    "estimation_method": "string", "estimation_method_detailed": "string", "all_motor_vehicles": "long", "cars_and_taxis": "long", "LGVs": "long",
    "all_HGVs": "long", "link_length_km": "double",
}
LINK_SCHEMA = "properties struct<segment_id:string,count_point_id:long,road_number:string,source_year:int>, geometry struct<type:string,coordinates:string>"


def _csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """All columns as strings: inference would cost a pass and lose leading zeros."""
    return spark.read.option("header", True).option("inferSchema", False).csv(paths)


def _typed(df: DataFrame, types: Mapping[str, str], *sentinels: str) -> DataFrame:
    return df.select(*(rates.cleaned(F.col(k), *sentinels).try_cast(v).alias(k) for k, v in types.items()))


def clean_collisions(raw: DataFrame) -> DataFrame:
    """Blank and -1 become null in every column; rows without an id go."""
    require_columns(raw, COLLISION_TYPES)
    return _typed(raw, COLLISION_TYPES, "", "-1").where("collision_index is not null")


def read_collisions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Collisions from CSV, or from Parquet where the first path ends so."""
    first = paths if isinstance(paths, str) else paths[0]
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths)) if first.endswith(".parquet") else clean_collisions(_csv(spark, paths))


def clean_traffic(raw: DataFrame) -> DataFrame:
    require_columns(raw, TRAFFIC_TYPES)
    return _typed(raw, TRAFFIC_TYPES, "", "NA").withColumnsRenamed({"LGVs": "lgvs", "all_HGVs": "all_hgvs"})


def read_traffic(spark: SparkSession, paths: str | list[str], *, year: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Traffic of a year, kept to the count points of ``ids`` by a semi-join."""
    out = clean_traffic(_csv(spark, paths))
    out = out.where(F.col("year") == year) if year is not None else out
    return out.join(ids.select("count_point_id").distinct(), "count_point_id", "left_semi") if ids is not None else out


def clean_urban_rural(raw: DataFrame) -> DataFrame:
    require_columns(raw, ("count_point_id", "year", "urban_rural"))
    return raw.select(
        F.col("count_point_id").try_cast("long").alias("count_point_id"), F.col("year").try_cast("int").alias("year"),
        F.lower(rates.cleaned(F.col("urban_rural"), "")).alias("urban_rural"),
    )


def read_urban_rural(spark: SparkSession, paths: str | list[str], *, year: int | None = None) -> DataFrame:
    out = clean_urban_rural(_csv(spark, paths))
    return out.where(F.col("year") == year) if year is not None else out


def _features(spark: SparkSession, path: str, feature: str, lines: bool, range_bytes: int) -> DataFrame:
    """Features of collections, or one feature a line, which splits over many tasks. A collection of more
    than ``range_bytes`` is read by such ranges, a smaller one by one task."""
    if lines:
        return spark.read.schema(feature).json(path)
    if ranges.files_of(spark, path).where(F.col("length") > range_bytes).isEmpty():
        rows = spark.read.option("multiLine", True).schema(f"features array<struct<{feature.replace(' ', ':', 1).replace(', geometry ', ',geometry:')}>>").json(path)
        return rows.select(F.explode("features").alias("f")).select("f.*")
    rows = ranges.collection_features(spark, path, size=range_bytes)
    return rows.where(F.get_json_object("value", "$.type") == "Feature").select(F.from_json("value", feature).alias("f")).select("f.*")


def read_links(spark: SparkSession, path: str, *, year: int | None = None, lines: bool = False, range_bytes: int = ranges.RANGE) -> DataFrame:
    """Links with ``parts``, an array of arrays of (lon, lat) vertices: LineString and MultiLineString."""
    rows = _features(spark, path, LINK_SCHEMA, lines, range_bytes)
    single = F.from_json("geometry.coordinates", "array<array<double>>")
    multi = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    parts = F.when(F.col("geometry.type") == "MultiLineString", multi).otherwise(F.array(single))
    out = rows.select("properties.*", parts.alias("parts"))
    return out.withColumn("source_year", F.lit(year)) if year is not None else out


def read_areas(spark: SparkSession, path: str, code: str = "OA11CD", *, lines: bool = False, range_bytes: int = ranges.RANGE) -> DataFrame:
    """Areas with ``rings``: area_id and arrays of (lon, lat) vertices of Polygon and MultiPolygon."""
    rows = _features(spark, path, f"properties struct<{code}:string>, geometry struct<type:string,coordinates:string>", lines, range_bytes)
    single = F.from_json("geometry.coordinates", "array<array<array<double>>>")
    multi = F.flatten(F.from_json("geometry.coordinates", "array<array<array<array<double>>>>"))
    return rows.select(F.col(f"properties.{code}").alias("area_id"), F.when(F.col("geometry.type") == "MultiPolygon", multi).otherwise(single).alias("rings"))


def vertices_to_pieces(df: DataFrame, lines: str, *ids: str) -> DataFrame:
    """Straight pieces of arrays of arrays of (a, b) vertices: ids, part, seq, a1, b1, a2, b2."""
    parts = df.select(*ids, F.posexplode(lines).alias("part", "_v"))
    steps = F.transform(F.sequence(F.lit(1), F.size("_v") - 1), lambda i: F.struct((i - 1).alias("seq"), F.element_at("_v", i).alias("p"), F.element_at("_v", i + 1).alias("q")))
    rows = parts.where(F.size("_v") > 1).select(*ids, "part", F.explode(steps).alias("_s"))
    return rows.select(*ids, "part", F.col("_s.seq").alias("seq"), F.col("_s.p")[0].alias("a1"), F.col("_s.p")[1].alias("b1"), F.col("_s.q")[0].alias("a2"), F.col("_s.q")[1].alias("b2"))


def read_years(spark: SparkSession, template: str, years: Iterable[int], *, history: str | None = None, history_years: Iterable[int] = ()) -> DataFrame:
    """Collisions of many years by one scan each of the yearly files and of the history file."""
    older, wanted = set(history_years), sorted(years)
    own = [y for y in wanted if history is None or y not in older]
    parts = []
    if own:
        parts.append(read_collisions(spark, [template.format(year=y) for y in own]))
    if history is not None and set(wanted) & older:
        parts.append(read_collisions(spark, history).where(F.col("collision_year").isin(sorted(set(wanted) & older))))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where(F.col("collision_year").isin(wanted))


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", *, whole: int = WHOLE) -> DataFrame:
    """filename (from the folder ``path`` on), bytes and SHA-256 of every file below it, many files at a time.

    Files of up to ``whole`` bytes are values of a row; larger ones are read through in pieces, each in one task.
    Empty files have no row, as Spark lists none."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    small = rows.where(F.col("length") <= whole).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = ranges.streamed_digests(ranges.files_of(spark, path, pattern).where(F.col("length") > whole))
    folder = path.split(":", 1)[-1].strip("/") + "/"
    return small.unionByName(large).select(F.substring_index("path", folder, -1).alias("filename"), F.col("length").alias("bytes"), "sha256")


def row_hash(df: DataFrame) -> Column:
    """What a digest adds up of each row."""
    return F.xxhash64(*df.columns).cast("decimal(38,0)")


def table_digest(df: DataFrame) -> DataFrame:
    """Row count and an order-independent sum of row hashes."""
    return df.select(row_hash(df).alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("h"), F.lit(0)).cast("string").alias("digest"))
