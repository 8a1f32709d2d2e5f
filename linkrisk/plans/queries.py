"""Registered queries: every operator over stand-in tables, with SQL for comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, rates
from ..operators import baseline, evidence, gates, matching, metrics, nb2, panel, polygons, ranking, screening, serving
from ..sources import files
from .standin import CONTRACT, sql_with, view

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BOX = (-1.75, 53.2, -1.35, 53.6)
GRID_BOX = (410000.0, 425000.0, 425000.0, 434000.0)
YEARS = "(1995, 1996, 1997, 1998, 1999, 2000)"
SPLIT = "CASE WHEN year <= 1998 THEN 'training' WHEN year = 1999 THEN 'validation' ELSE 'test' END"


def query(sql: str | None = None, *views: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql_with(sql, *views) if views else sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


# ---- sources, gates, projections ------------------------------------------------------------


@query(
    f"""SELECT collision_index, collision_year, date, collision_severity, longitude, latitude, lower(local_authority_highway_current) AS authority
        FROM collision WHERE collision_year = 1996 AND longitude BETWEEN {BOX[0]} AND {BOX[2]} AND latitude BETWEEN {BOX[1]} AND {BOX[3]}""",
    "collision",
)
def pilot_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = serving.in_box(gates.require_year(view(spark, sf_dir, "collision"), 1996), BOX)
    as_text = rows.withColumn("date", F.date_format("date", "dd/MM/yyyy"))  # dates come as text
    out = as_text.select("collision_index", "collision_year", rates.try_date(F.col("date")).alias("date"), "collision_severity", "longitude", "latitude", F.lower("local_authority_highway_current").alias("authority"))
    return out.orderBy("date", "collision_index")


@query(
    f"""SELECT count(*) AS source_records, count_if(collision_year = 1996) AS selected_source_records,
               count_if(collision_year = 1996 AND longitude BETWEEN {BOX[0]} AND {BOX[2]} AND latitude BETWEEN {BOX[1]} AND {BOX[3]}) AS pilot_records,
               count_if(longitude IS NULL OR latitude IS NULL) AS missing_source_coordinates FROM collision""",
    "collision",
)
def pilot_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.pilot_quality(view(spark, sf_dir, "collision"), BOX, year=1996)


@query("SELECT collision_year, collision_severity, count(*) AS n FROM collision GROUP BY ALL", "collision")
def severity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.severity_counts(view(spark, sf_dir, "collision"), ("collision_year",))


@query("""SELECT CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE cast(o_orderkey AS string) END AS collision_index, cast(year(o_orderdate) AS int) AS collision_year,
                 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE cast(1 + o_orderkey % 3 AS int) END AS number_of_vehicles,
                 CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE cast(30 AS int) END AS speed_limit
          FROM orders WHERE o_orderkey % 50 <> 0""")
def sentinel_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    raw = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(key % 50 == 0, "").otherwise(key.cast("string")).alias("collision_index"), F.year("o_orderdate").cast("string").alias("collision_year"),
        F.when(key % 7 == 0, "-1").otherwise((1 + key % 3).cast("string")).alias("number_of_vehicles"), F.when(key % 11 == 0, "").otherwise("30").alias("speed_limit"),
        *(F.lit("-1").alias(c) for c in files.COLLISION_TYPES if c not in ("collision_index", "collision_year", "number_of_vehicles", "speed_limit")),
    )
    return files.clean_collisions(raw).select("collision_index", "collision_year", "number_of_vehicles", "speed_limit")


@query("""SELECT count_if(coalesce(collision_severity NOT IN (1, 3), false)) AS severity_outside, count(*) AS n_rows,
                 (SELECT count_if(road_type NOT IN ('type-0', 'type-1')) FROM link) AS road_type_outside,
                 (SELECT count(DISTINCT segment_id) FROM link) AS n_segment_ids FROM collision""", "collision", "link")
def domain_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "collision").agg(F.count_if(gates.outside_domain(F.col("collision_severity"), (1, 3))).alias("severity_outside"), F.count(F.lit(1)).alias("n_rows"))
    links = view(spark, sf_dir, "link")
    more = links.agg(F.count_if(gates.outside_domain(F.col("road_type"), ("type-0", "type-1"))).alias("road_type_outside"))
    return rows.join(more).join(gates.link_uniqueness(links).select("n_segment_ids"))


@query("SELECT cast(coalesce(sum(n), 0) AS bigint) AS duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1)")
def duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.duplicate_rows(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey", "l_partkey")


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_orderkey, l_suppkey) > 1 AS is_duplicated FROM lineitem")
def duplicate_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_suppkey")
    return gates.flag_duplicates(rows, "l_orderkey", "l_suppkey").select("l_orderkey", "l_linenumber", "is_duplicated")


@query("""SELECT collision_year, count(*) AS n, collision_year = 1996 AS is_network_year, (SELECT count(*) FROM panel WHERE year <> source_year) AS inconsistent_rows
          FROM collision GROUP BY collision_year""", "collision", "panel")
def year_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = view(spark, sf_dir, "collision").groupBy("collision_year").agg(F.count(F.lit(1)).alias("n")).withColumn("is_network_year", F.col("collision_year") == 1996)
    return years.join(view(spark, sf_dir, "panel").agg(F.count_if(F.col("year") != F.col("source_year")).alias("inconsistent_rows")))


@query(f"""SELECT {SPLIT} AS evaluation_split, count(*) AS n_rows, count_if(annual_vehicle_km IS NULL OR annual_vehicle_km <= 0) AS invalid_exposure_rows,
                  count_if(ksi_count IS NULL OR ksi_count < 0) AS invalid_target_rows, round(sum(annual_vehicle_km), 2) AS total_exposure
           FROM panel WHERE year IN {YEARS} GROUP BY 1""", "panel")
def row_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT)
    return rounded(gates.row_validity(rows, F.col("evaluation_split")), "total_exposure", places=2)


@query("""SELECT *, missing_years = '' AS valid FROM (SELECT count(*) AS collision_records, min(collision_year) AS available_year_min, max(collision_year) AS available_year_max,
                 coalesce((SELECT string_agg(y, ',' ORDER BY y) FROM (VALUES (1994), (1995), (2031)) v(y) WHERE y NOT IN (SELECT collision_year FROM collision)), '') AS missing_years FROM collision)""", "collision")
def source_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gates.source_coverage(view(spark, sf_dir, "collision"), (1994, 1995, 2031))
    return found.withColumn("missing_years", F.array_join(F.col("missing_years").cast("array<string>"), ","))


@query(f"SELECT segment_key, year, {SPLIT} AS evaluation_split FROM panel WHERE year IN {YEARS}", "panel")
def split_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.labelled(view(spark, sf_dir, "panel"), CONTRACT).select("segment_key", "year", "evaluation_split")


@query("SELECT count(*) AS n_rows, cast(sum(l_linenumber) AS bigint) AS line_sum FROM lineitem")
def table_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return files.table_digest(rows).select("n_rows").join(rows.agg(F.sum("l_linenumber").alias("line_sum")))


# ---- geometry and matching ------------------------------------------------------------------

DISTANCES = """, pairs AS (
    SELECT collision_index, segment_id,
           greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t, x, y, x1, y1, x2, y2
    FROM collision, link{where}),
  near AS (SELECT collision_index, segment_id, sqrt((x - x1 - t * (x2 - x1)) * (x - x1 - t * (x2 - x1)) + (y - y1 - t * (y2 - y1)) * (y - y1 - t * (y2 - y1))) AS d FROM pairs)"""
CLOSE = " WHERE x BETWEEN least(x1, x2) - 50 AND greatest(x1, x2) + 50 AND y BETWEEN least(y1, y2) - 50 AND greatest(y1, y2) + 50"
STATUS = """, ranked AS (SELECT *, row_number() OVER (PARTITION BY collision_index ORDER BY d, segment_id) AS k, count(*) OVER (PARTITION BY collision_index) AS n FROM near WHERE d <= 50),
  top AS (SELECT collision_index, max(n) AS n, max(CASE WHEN k = 1 THEN segment_id END) AS s, max(CASE WHEN k = 1 THEN d END) AS d1, max(CASE WHEN k = 2 THEN d END) AS d2
          FROM ranked WHERE k <= 2 GROUP BY collision_index),
  matched AS (SELECT c.collision_index, c.collision_severity, c.collision_year, s, d1, d2, coalesce(n, 0) AS candidate_count,
                     CASE WHEN d1 IS NULL THEN 'out_of_range' WHEN d2 - d1 <= 10 THEN 'ambiguous' ELSE 'accepted' END AS match_status
              FROM collision c LEFT JOIN top USING (collision_index))"""


def _chained(body: str, *views: str) -> str:
    """Further common table expressions (from a comma on) and a SELECT after those of the views."""
    return sql_with("", *views).rstrip() + body


def _accepted(spark: SparkSession, sf_dir: str, with_nearest: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of accepted points do not need the nearest lines of the others."""
    points, links = view(spark, sf_dir, "collision"), view(spark, sf_dir, "link")
    return points, links, matching.match(points, links, with_nearest=with_nearest)


def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.within_distance(view(spark, sf_dir, "collision"), view(spark, sf_dir, "link"), 50.0, digits=6)


def match_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.nearest(view(spark, sf_dir, "collision"), view(spark, sf_dir, "link")).select("collision_index", "segment_id", F.round("distance", 4).alias("distance"))


def match_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _accepted(spark, sf_dir, with_nearest=True)[2].select("collision_index", "match_status", "segment_id", "nearest_segment_id", "distance_m", "second_distance_m", "candidate_count")


def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.match_quality(_accepted(spark, sf_dir)[2])


def segment_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, links, matches = _accepted(spark, sf_dir)
    traffic = view(spark, sf_dir, "traffic").where("year = 1996")
    traffic = traffic.join(links.select("count_point_id").distinct(), "count_point_id", "left_semi")
    lookup = links.select("count_point_id", "urban_rural")
    counts = evidence.accepted_counts(matches, points)
    out = evidence.segment_evidence(links.drop("urban_rural"), traffic, counts, lookup)
    return rounded(out, "annual_vehicle_km", "collision_rate_per_100m_vehicle_km").select(
        "segment_id", "count_point_id", "road_number", "year", "all_motor_vehicles", "estimation_method", "urban_rural", "collision_count", "ksi_count", "annual_vehicle_km", "collision_rate_per_100m_vehicle_km"
    )


for _f, _sql in (
    (match_candidates, DISTANCES.format(where=CLOSE) + " SELECT collision_index, segment_id, round(d, 6) AS distance FROM near WHERE d <= 50"),
    (match_nearest, DISTANCES.format(where="") + " SELECT collision_index, arg_min(segment_id, (d, segment_id)) AS segment_id, round(min(d), 4) AS distance FROM near GROUP BY collision_index"),
    (match_status, DISTANCES.format(where="") + STATUS + """, far AS (SELECT collision_index, arg_min(segment_id, (d, segment_id)) AS f, min(d) AS fd FROM near GROUP BY collision_index)
         SELECT collision_index, match_status, CASE WHEN match_status = 'accepted' THEN s END AS segment_id, coalesce(s, f) AS nearest_segment_id,
         round_even(coalesce(d1, fd), 2) AS distance_m, round_even(d2, 2) AS second_distance_m, candidate_count FROM matched LEFT JOIN far USING (collision_index)"""),
    (match_quality, DISTANCES.format(where=CLOSE) + STATUS + """ SELECT count(*) AS collision_records, count_if(match_status = 'accepted') AS accepted, count_if(match_status = 'ambiguous') AS ambiguous,
         count_if(match_status = 'out_of_range') AS out_of_range, round(count_if(match_status = 'accepted') / count(*), 4) AS accepted_match_rate FROM matched"""),
    (segment_evidence, DISTANCES.format(where=CLOSE) + STATUS + """, counts AS (SELECT s, count(*) AS c, count_if(collision_severity IN (1, 2)) AS k FROM matched WHERE match_status = 'accepted' GROUP BY s),
         j AS (SELECT link.*, t.year, t.all_motor_vehicles, t.estimation_method, coalesce(c, 0) AS collision_count, coalesce(k, 0) AS ksi_count, all_motor_vehicles * 365 * link_length_km AS km
               FROM link LEFT JOIN (SELECT * FROM traffic WHERE year = 1996) t USING (count_point_id) LEFT JOIN counts ON s = segment_id)
         SELECT segment_id, count_point_id, road_number, year, all_motor_vehicles, estimation_method, urban_rural, collision_count, ksi_count, round(km, 6) AS annual_vehicle_km,
                round(CASE WHEN km > 0 THEN collision_count / km * 1e8 END, 6) AS collision_rate_per_100m_vehicle_km FROM j"""),
):
    QUERIES[_f.__name__] = _f
    ORACLES[_f.__name__] = _chained(_sql, "collision", "link", *(["traffic"] if _f is segment_evidence else []))


@query("""SELECT year, count(*) AS road_segments, count(all_motor_vehicles) AS segments_with_exposure, round(count(all_motor_vehicles) / count(*), 4) AS exposure_coverage, count(urban_rural) AS segments_with_urban_rural,
                 round(count(urban_rural) / count(*), 4) AS urban_rural_coverage, string_agg(DISTINCT local_authority_code, ',' ORDER BY local_authority_code) AS local_authorities
          FROM panel GROUP BY year""", "panel")
def network_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.network_quality(view(spark, sf_dir, "panel"), by=("year",))


@query("""SELECT 'method' AS kind, estimation_method AS value, count(*) AS n FROM traffic GROUP BY ALL
          UNION ALL SELECT 'class', urban_rural, count(*) FROM link WHERE urban_rural IS NOT NULL GROUP BY ALL""", "traffic", "link")
def network_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = evidence.method_counts(view(spark, sf_dir, "traffic")).select(F.lit("method").alias("kind"), F.col("estimation_method").alias("value"), "n")
    return methods.unionByName(evidence.class_counts(view(spark, sf_dir, "link")).select(F.lit("class").alias("kind"), F.col("urban_rural").alias("value"), "n"))


def _box_sql() -> str:
    a, b, c, d = GRID_BOX
    inside = lambda x, y: f"({x} BETWEEN {a} AND {c} AND {y} BETWEEN {b} AND {d})"
    side = lambda px, py, qx, qy: f"sign((x2 - x1) * ({py} - y1) - (y2 - y1) * ({px} - x1)) * sign((x2 - x1) * ({qy} - y1) - (y2 - y1) * ({qx} - x1)) <= 0 AND " + (f"(y1 - {py}) * (y2 - {py}) <= 0" if py == qy else f"(x1 - {px}) * (x2 - {px}) <= 0")
    edges = [(a, b, c, b), (a, d, c, d), (a, b, a, d), (c, b, c, d)]
    return f"SELECT segment_id FROM link WHERE {inside('x1', 'y1')} OR {inside('x2', 'y2')} OR " + " OR ".join(f"({side(*e)})" for e in edges)


@query(_box_sql(), "link")
def links_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.lines_in_box(view(spark, sf_dir, "link"), GRID_BOX)


@query("SELECT segment_id, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) / 1000, 6) AS geometry_length_km FROM link", "link")
def segment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matching.line_length(view(spark, sf_dir, "link")), "geometry_length_km")


@query("SELECT segment_key, segment_id FROM panel", "panel")
def segment_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "panel")
    return rows.select(rates.segment_key(F.col("count_point_id")).alias("segment_key"), rates.segment_id(F.col("year"), F.col("count_point_id")).alias("segment_id"))


def _steps_sql(steps: geo.Steps, start: str, keep: str) -> str:
    parts, before = [], start
    for k, (name, sql) in enumerate(steps):
        parts.append(f"s{k} AS (SELECT *, {sql} AS {name} FROM {before})")
        before = f"s{k}"
    return ", " + ", ".join(parts) + f" SELECT {keep} FROM {before}"


def project_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geo.to_grid(view(spark, sf_dir, "collision").select("collision_index", "longitude", "latitude"))
    return rows.select("collision_index", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def unproject_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = geo.to_degrees(view(spark, sf_dir, "collision").select("collision_index", "x", "y"))
    return rows.select("collision_index", F.round("longitude", 6).alias("longitude"), F.round("latitude", 6).alias("latitude"))


QUERIES |= {"project_points": project_points, "unproject_points": unproject_points}
ORACLES["project_points"] = _chained(", own AS (SELECT collision_index, longitude, latitude FROM collision)" + _steps_sql(geo.forward_steps("longitude", "latitude", "x", "y"), "own", "collision_index, round(x, 3) AS x, round(y, 3) AS y"), "collision")
ORACLES["unproject_points"] = _chained(", own AS (SELECT collision_index, x, y FROM collision)" + _steps_sql(geo.inverse_steps("x", "y", "longitude", "latitude"), "own", "collision_index, round(longitude, 6) AS longitude, round(latitude, 6) AS latitude"), "collision")


@query("SELECT collision_index, area_id FROM collision, area WHERE abs(x - cx) * 1500 + abs(y - cy) * 3500 <= 3500 * 1500", "collision", "area")
def point_in_polygon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return polygons.in_area(view(spark, sf_dir, "collision"), view(spark, sf_dir, "edge"), point_id="collision_index")


AREA_CLASS = """, d AS (
    SELECT {id} AS id, area_id, urban_rural, abs({x} - cx) * 1500 + abs({y} - cy) * 3500 <= 3500 * 1500 AS inside,
           greatest(0.0, least(1.0, ((3500 - abs({x} - cx)) * 3500 + abs({y} - cy) * 1500) / (3500.0 * 3500 + 1500.0 * 1500))) AS t, abs({x} - cx) AS ux, abs({y} - cy) AS uy
    FROM {points}, area),
  e AS (SELECT *, sqrt((ux - 3500 * (1 - t)) * (ux - 3500 * (1 - t)) + (uy - 1500 * t) * (uy - 1500 * t)) AS dist FROM d),
  c AS (SELECT id, arg_min(urban_rural, area_id) FILTER (inside) AS own, arg_min(urban_rural, (dist, area_id)) FILTER (dist <= 500) AS near FROM e GROUP BY id)"""


def area_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = view(spark, sf_dir, "area").select("area_id", "urban_rural")
    return polygons.classify(view(spark, sf_dir, "collision"), view(spark, sf_dir, "edge"), areas, point_id="collision_index")


def area_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = view(spark, sf_dir, "link")
    points = matching.clipped_point(links, GRID_BOX)
    classes = polygons.classify(points, view(spark, sf_dir, "edge"), view(spark, sf_dir, "area").select("area_id", "urban_rural"), point_id="segment_id")
    rows = links.select("segment_id", "count_point_id").join(classes, "segment_id")
    return rows.select("count_point_id", F.lit(1996).alias("year"), "urban_rural").distinct().orderBy("year", "count_point_id")


def area_unclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the areas have no class; points in them have none, though others lie within the distance."""
    areas = view(spark, sf_dir, "area").select("area_id", F.when(F.col("area_id").cast("int") % 3 != 1, F.col("urban_rural")).alias("urban_rural"))
    return polygons.classify(view(spark, sf_dir, "collision"), view(spark, sf_dir, "edge"), areas, point_id="collision_index", max_distance=2000.0)


QUERIES |= {"area_class": area_class, "area_lookup": area_lookup, "area_unclassified": area_unclassified}
ORACLES["area_unclassified"] = _chained(
    """, d AS (
      SELECT collision_index, area_id, CASE WHEN cast(area_id AS int) % 3 <> 1 THEN urban_rural ELSE '-' END AS class, abs(x - cx) * 1500 + abs(y - cy) * 3500 <= 3500 * 1500 AS inside, abs(x - cx) AS ux, abs(y - cy) AS uy,
             greatest(0.0, least(1.0, ((3500 - abs(x - cx)) * 3500 + abs(y - cy) * 1500) / (3500.0 * 3500 + 1500.0 * 1500))) AS t FROM collision, area),
    e AS (SELECT *, CASE WHEN inside THEN 0 ELSE sqrt((ux - 3500 * (1 - t)) * (ux - 3500 * (1 - t)) + (uy - 1500 * t) * (uy - 1500 * t)) END AS dist FROM d)
    SELECT collision_index, nullif(arg_min(class, (dist, area_id)) FILTER (dist <= 2000), '-') AS urban_rural FROM e GROUP BY collision_index""",
    "collision", "area",
)
ORACLES["area_class"] = _chained(AREA_CLASS.format(id="collision_index", x="x", y="y", points="collision") + " SELECT id AS collision_index, coalesce(own, near) AS urban_rural FROM c", "collision", "area")
_A, _B, _C, _D = GRID_BOX
ORACLES["area_lookup"] = _chained(
    f""", k AS (SELECT count_point_id, x1, y1, x2, y2,
              greatest(0.0, CASE WHEN x2 > x1 THEN ({_A} - x1) / (x2 - x1) ELSE 0 END, CASE WHEN y2 > y1 THEN ({_B} - y1) / (y2 - y1) WHEN y2 < y1 THEN ({_D} - y1) / (y2 - y1) WHEN y1 BETWEEN {_B} AND {_D} THEN 0 ELSE 2 END) AS a,
              least(1.0, CASE WHEN x2 > x1 THEN ({_C} - x1) / (x2 - x1) ELSE 1 END, CASE WHEN y2 > y1 THEN ({_D} - y1) / (y2 - y1) WHEN y2 < y1 THEN ({_B} - y1) / (y2 - y1) WHEN y1 BETWEEN {_B} AND {_D} THEN 1 ELSE -1 END) AS b
            FROM link),
         m AS (SELECT count_point_id, x1 + (x2 - x1) * (a + b) / 2 AS mx, y1 + (y2 - y1) * (a + b) / 2 AS my FROM k WHERE a <= b)"""
    + AREA_CLASS.format(id="count_point_id", x="mx", y="my", points="m")
    + " SELECT id AS count_point_id, 1996 AS year, coalesce(own, near) AS urban_rural FROM c",
    "link", "area",
)


# ---- panel ----------------------------------------------------------------------------------


@query("""SELECT segment_key, year, cast(all_motor_vehicles AS double) AS flow, CASE WHEN year = 1995 THEN NULL ELSE urban_rural END AS urban_rural,
                 cast(local_authority_id AS string) AS code FROM panel WHERE year IN (1995, 1996)""", "panel")
def union_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "panel")
    first = rows.where("year = 1995").select("segment_key", "year", F.col("all_motor_vehicles").alias("flow"), F.col("local_authority_id").alias("code"))
    second = rows.where("year = 1996").select("segment_key", "year", F.col("all_motor_vehicles").cast("double").alias("flow"), "urban_rural", F.col("local_authority_id").cast("string").alias("code"))
    return panel.union_relaxed([first, second]).select("segment_key", "year", F.col("flow").cast("double").alias("flow"), "urban_rural", "code")


@query("SELECT year, count(*) AS n_rows, count(DISTINCT segment_key) AS segments FROM panel GROUP BY year", "panel")
def panel_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "panel")
    years = gates.years_of(rows, "year")
    return panel.panel_years(panel.build_panel([rows.where(F.col("year") == y) for y in years]))


WIDER = panel.Contract((1995, 1996), (1999,), (2000, 2031), ("road_category", "urban_rural", "local_authority", "weather"))


@query("SELECT y AS year FROM (VALUES (1995), (1996), (1999), (2000), (2031)) v(y) WHERE y NOT IN (SELECT year FROM panel)", "panel")
def missing_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.missing_years(view(spark, sf_dir, "panel"), WIDER)


@query("""SELECT subgroup, subgroup <> 'weather' AS available, CASE subgroup WHEN 'urban_rural' THEN (SELECT count(*) FROM panel WHERE urban_rural IS NULL AND year IN (1995, 1996, 1999, 2000)) ELSE 0 END AS incomplete_rows
          FROM (VALUES ('road_category'), ('urban_rural'), ('local_authority'), ('weather')) v(subgroup)""", "panel")
def subgroup_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.subgroup_coverage(view(spark, sf_dir, "panel"), WIDER)


@query(f"SELECT segment_key, count(DISTINCT year) AS years FROM panel WHERE year IN {YEARS} GROUP BY segment_key HAVING count(DISTINCT year) = 6", "panel")
def complete_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.complete_history(view(spark, sf_dir, "panel"), CONTRACT)


READINESS = f""", c AS (
      SELECT count_if(urban_rural IS NULL OR trim(urban_rural) = '') AS u, count_if(road_category IS NULL OR trim(road_category) = '') AS r, count_if(local_authority_code IS NULL OR trim(local_authority_code) = '') AS l,
             count_if(annual_vehicle_km IS NULL OR annual_vehicle_km <= 0) AS invalid_exposure_rows, count_if(ksi_count IS NULL OR ksi_count < 0) AS invalid_target_rows, count(DISTINCT local_authority_code) AS geographic_groups,
             (SELECT count(*) FROM (SELECT 1 FROM panel WHERE year IN {YEARS} GROUP BY segment_key HAVING count(DISTINCT year) = 6)) AS segments_with_complete_history,
             (SELECT coalesce(string_agg(y, ',' ORDER BY y), '') FROM (VALUES (1995), (1996), (1997), (1998), (1999), (2000)) v(y) WHERE y NOT IN (SELECT year FROM panel)) AS missing_years
      FROM panel WHERE year IN {YEARS}),
    k AS (SELECT *, list_filter([CASE WHEN missing_years <> '' THEN 'missing_contract_years' END, CASE WHEN r + u + l > 0 THEN 'incomplete_subgroup_values' END,
                     CASE WHEN geographic_groups < 2 THEN 'insufficient_geographic_groups' END, CASE WHEN invalid_exposure_rows > 0 THEN 'invalid_exposure_rows' END,
                     CASE WHEN invalid_target_rows > 0 THEN 'invalid_target_rows' END], lambda x: x IS NOT NULL) AS b FROM c)
    SELECT CASE WHEN len(b) = 0 THEN 'ready-for-evaluation' ELSE 'blocked' END AS status, array_to_string(b, ',') AS blockers, (6 - len(b)) / 6.0::DOUBLE AS readiness_score,
           missing_years = '' AS contract_years_available, true AS required_subgroups_available, r + u + l = 0 AS subgroup_values_complete, geographic_groups >= 2 AS geographic_holdout_possible,
           invalid_exposure_rows = 0 AS exposure_values_valid, invalid_target_rows = 0 AS target_values_valid, '1995,1996,1997,1998,1999,2000' AS required_years,
           (SELECT string_agg(DISTINCT year, ',' ORDER BY year) FROM panel) AS available_years, missing_years, '' AS missing_subgroups,
           concat_ws(',', CASE WHEN r > 0 THEN 'road_category=' || r END, CASE WHEN u > 0 THEN 'urban_rural=' || u END, CASE WHEN l > 0 THEN 'local_authority=' || l END) AS incomplete_subgroup_rows,
           invalid_exposure_rows, invalid_target_rows, geographic_groups, segments_with_complete_history FROM k"""


def panel_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.readiness(view(spark, sf_dir, "panel"), CONTRACT)


QUERIES["panel_readiness"] = panel_readiness
ORACLES["panel_readiness"] = _chained(READINESS, "panel")


# ---- screening ------------------------------------------------------------------------------

ROLLUP = """, r AS (
    SELECT segment_key, arg_min(road_number, year) AS road_number, arg_min(road_category, year) AS road_category, arg_min(local_authority_code, year) AS local_authority_code,
           arg_min(urban_rural, year) AS urban_rural, count(DISTINCT year) AS years_observed, cast(sum(cast(annual_vehicle_km AS decimal(38, 6))) AS double) / 1e6 AS mv, cast(sum(collision_count) AS bigint) AS c, cast(sum(ksi_count) AS bigint) AS k
    FROM panel GROUP BY segment_key),
  o AS (SELECT *, row_number() OVER (ORDER BY k / mv DESC, c / mv DESC, segment_key) AS screening_rank FROM r)
  SELECT screening_rank, segment_key, road_number, road_category, local_authority_code, urban_rural, years_observed, c AS observed_collisions, k AS observed_ksi, round(mv, 6) AS total_million_vehicle_km,
         round(c / mv, 6) AS collision_rate_per_million_vehicle_km, round(k / mv, 6) AS ksi_rate_per_million_vehicle_km, round(sqrt(k) / mv, 6) AS ksi_rate_standard_error_proxy,
         CASE WHEN k >= 5 AND mv >= 1 THEN 'more_stable' ELSE 'interpret_with_caution' END AS screening_stability FROM o"""
RATES = ("total_million_vehicle_km", "collision_rate_per_million_vehicle_km", "ksi_rate_per_million_vehicle_km", "ksi_rate_standard_error_proxy")
SCREENED = ("segment_key", "road_number", "road_category", "local_authority_code", "urban_rural", "years_observed", "observed_collisions", "observed_ksi", *RATES, "screening_stability")


def segment_screening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.screen(view(spark, sf_dir, "panel")), *RATES).select("screening_rank", *SCREENED)


def top_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(screening.top_segments(view(spark, sf_dir, "panel"), 10), *RATES).select(*SCREENED)


QUERIES |= {"segment_screening": segment_screening, "top_segments": top_segments}
ORACLES["segment_screening"] = _chained(ROLLUP, "panel")
ORACLES["top_segments"] = f"SELECT {', '.join(SCREENED)} FROM ({_chained(ROLLUP, 'panel')}) WHERE screening_rank <= 10"


@query("""SELECT subgroup, value, count(*) AS n_rows, cast(sum(collision_count) AS bigint) AS observed_collisions, cast(sum(ksi_count) AS bigint) AS observed_ksi,
                 round(sum(annual_vehicle_km) / 1e6, 6) AS total_million_vehicle_km, round(sum(collision_count) / (sum(annual_vehicle_km) / 1e6), 6) AS collision_rate_per_million_vehicle_km,
                 round(sum(ksi_count) / (sum(annual_vehicle_km) / 1e6), 6) AS ksi_rate_per_million_vehicle_km
          FROM (SELECT 'road_category' AS subgroup, road_category AS value, * FROM panel UNION ALL SELECT 'urban_rural', urban_rural, * FROM panel
                UNION ALL SELECT 'local_authority_code', local_authority_code, * FROM panel) WHERE value IS NOT NULL GROUP BY subgroup, value""", "panel")
def subgroup_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rounded(screening.subgroup_rates(view(spark, sf_dir, "panel")), *RATES[:3])
    return out.drop("total_vehicle_km")


# ---- models ---------------------------------------------------------------------------------

BASE = f""", rate AS (SELECT sum(ksi_count) / sum(annual_vehicle_km) AS r FROM panel WHERE year BETWEEN 1995 AND 1998),
  pred AS (SELECT *, {SPLIT} AS evaluation_split, r * annual_vehicle_km AS expected_ksi FROM panel, rate WHERE year IN (1999, 2000))"""


def _metrics_sql(source: str, by: str) -> str:
    return f""", flagged AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY expected_ksi DESC, segment_key, year) <= greatest(1, ceil(count(*) OVER (PARTITION BY {by}) * 0.1)) AS in_top FROM {source}),
      m AS (SELECT {by}, count(*) AS n_rows, avg(abs(ksi_count - expected_ksi)) AS mae, sqrt(avg((ksi_count - expected_ksi) * (ksi_count - expected_ksi))) AS rmse,
                   2 * sum(CASE WHEN ksi_count > 0 THEN ksi_count * ln(ksi_count / expected_ksi) - (ksi_count - expected_ksi) ELSE expected_ksi END) AS poisson_deviance,
                   avg(ksi_count) AS mean_actual, avg(expected_ksi) AS mean_predicted, sum(ksi_count) / sum(expected_ksi) AS calibration_ratio,
                   sum(ksi_count) FILTER (in_top) AS top, count_if(in_top) AS k, sum(ksi_count) AS total FROM flagged GROUP BY {by})
      SELECT {by}, n_rows, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(poisson_deviance, 4) AS poisson_deviance, round(mean_actual, 6) AS mean_actual, round(mean_predicted, 6) AS mean_predicted,
             round(calibration_ratio, 6) AS calibration_ratio, round(top / k, 6) AS precision_at_10_percent, round(top / total, 6) AS recall_at_10_percent, round(top / total / (k / n_rows), 6) AS lift_at_10_percent FROM m"""


def _baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baseline.exposure_baseline(view(spark, sf_dir, "panel"), CONTRACT)


def _round_metrics(df: DataFrame) -> DataFrame:
    names = [c for c, t in df.dtypes if t == "double" and c != "poisson_deviance"]
    return rounded(df, *names).withColumn("poisson_deviance", F.round("poisson_deviance", 4))


def baseline_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_baseline(spark, sf_dir), "expected_ksi").select("segment_key", "year", "ksi_count", "expected_ksi", "evaluation_split")


def baseline_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.error_metrics(_baseline(spark, sf_dir)), "mae", "rmse")


def detailed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(metrics.detailed_metrics(_baseline(spark, sf_dir)))


def subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(metrics.subgroup_metrics(_baseline(spark, sf_dir)))


QUERIES |= {f.__name__: f for f in (baseline_predictions, baseline_metrics, detailed_metrics, subgroup_metrics)}
ORACLES["baseline_predictions"] = _chained(BASE + " SELECT segment_key, year, ksi_count, round(expected_ksi, 6) AS expected_ksi, evaluation_split FROM pred", "panel")
ORACLES["baseline_metrics"] = _chained(BASE + " SELECT evaluation_split, count(*) AS n_rows, round(avg(abs(ksi_count - expected_ksi)), 6) AS mae, round(sqrt(avg((ksi_count - expected_ksi) ** 2)), 6) AS rmse FROM pred GROUP BY 1", "panel")
ORACLES["detailed_metrics"] = _chained(BASE + _metrics_sql("pred", "evaluation_split"), "panel")
ORACLES["subgroup_metrics"] = _chained(
    BASE + """, long AS (SELECT 'road_category' AS subgroup, road_category AS value, * FROM pred UNION ALL SELECT 'urban_rural', urban_rural, * FROM pred WHERE urban_rural IS NOT NULL
                         UNION ALL SELECT 'estimation_method', estimation_method, * FROM pred)""" + _metrics_sql("long", "subgroup, value"), "panel")  # fmt: skip


@query(f"""SELECT feature, string_agg(DISTINCT v, ',' ORDER BY v) AS levels FROM (
             SELECT 'road_category' AS feature, road_category AS v FROM panel WHERE year <= 1998 AND year IN {YEARS} UNION ALL SELECT 'road_type', road_type FROM panel WHERE year <= 1998 AND year IN {YEARS}
             UNION ALL SELECT 'urban_rural', coalesce(urban_rural, '__missing__') FROM panel WHERE year <= 1998 AND year IN {YEARS}
             UNION ALL SELECT 'estimation_method', estimation_method FROM panel WHERE year <= 1998 AND year IN {YEARS}) GROUP BY feature""", "panel")
def feature_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT).where("evaluation_split = 'training'")
    return nb2.feature_levels(rows).select("feature", F.array_join("levels", ",").alias("levels"))


@query(f"""SELECT segment_key, year, cast(coalesce(urban_rural, '__missing__') = 'rural' AS int) AS is_rural, cast(coalesce(urban_rural, '__missing__') = 'urban' AS int) AS is_urban,
                  cast(road_type = 'type-1' AS int) AS is_type_1, cast(road_type = 'type-2' AS int) AS is_type_2 FROM panel WHERE year IN {YEARS} AND year > 1998""", "panel")
def design_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT)
    specs = nb2.feature_specs(rows.where("evaluation_split = 'training'"), ("road_type", "urban_rural"))
    out = nb2.design(rows.where("evaluation_split <> 'training'"), specs)
    return out.select("segment_key", "year", *(F.col(f"x_{c}").cast("int").alias(k) for k, c in (("is_rural", "urban_rural_rural"), ("is_urban", "urban_rural_urban"), ("is_type_1", "road_type_type-1"), ("is_type_2", "road_type_type-2"))))


@query("""SELECT DISTINCT CASE year WHEN 1999 THEN 'validation' ELSE 'test' END AS evaluation_split, local_authority_code FROM panel
          WHERE year IN (1999, 2000) AND local_authority_code NOT IN (SELECT local_authority_code FROM panel WHERE year NOT IN (1999, 2000))""", "panel")
def unseen_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nb2.unseen_authorities(view(spark, sf_dir, "panel"), CONTRACT)


@query(f"""SELECT segment_key, year, evaluation_split, row_number() OVER (PARTITION BY evaluation_split ORDER BY annual_vehicle_km DESC, segment_key, year) AS exposure_rank
           FROM (SELECT *, {SPLIT} AS evaluation_split FROM panel WHERE year IN {YEARS})""", "panel")
def exposure_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT).select("segment_key", "year", "evaluation_split", "annual_vehicle_km")
    return ranking.ranked(rows, [F.desc("annual_vehicle_km"), F.asc("segment_key"), F.asc("year")], "exposure_rank", by=("evaluation_split",)).drop("annual_vehicle_km")


def _training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = panel.labelled(view(spark, sf_dir, "panel"), CONTRACT)
    return rows.where("evaluation_split = 'training'"), rows.where("evaluation_split <> 'training'")


@query()
def nb2_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    training, _ = _training(spark, sf_dir)
    return rounded(nb2.coefficients(nb2.fit(training, nb2.feature_specs(training)), training), "estimate")


@query()
def nb2_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    training, scoring = _training(spark, sf_dir)
    out = nb2.predict(nb2.fit(training, nb2.feature_specs(training)), scoring)
    names = ("expected_ksi", "expected_ksi_std", "expected_ksi_lower_95", "expected_ksi_upper_95")
    return rounded(out, *names).select("segment_key", "year", "ksi_count", *names, "evaluation_split")


@query()
def authority_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_metrics(nb2.authority_holdout(_training(spark, sf_dir)[0]))


@query()
def promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(nb2.promotion(nb2.safety_performance(view(spark, sf_dir, "panel"), CONTRACT)), "test_mae", "baseline_test_mae", "holdout_mae", "baseline_holdout_mae")


# ---- listings -------------------------------------------------------------------------------


@query("SELECT collision_index, date, collision_severity FROM collision WHERE collision_severity = 2 ORDER BY date, collision_index LIMIT 500", "collision")
def list_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.list_collisions(view(spark, sf_dir, "collision"), severity=2, limit=500).select("collision_index", "date", "collision_severity")


@query("""SELECT collision_index AS collision_id, collision_year AS year, collision_severity AS severity,
                 CASE collision_severity WHEN 1 THEN 'Fatal' WHEN 2 THEN 'Serious' WHEN 3 THEN 'Slight' END AS severity_label, number_of_vehicles AS vehicles, number_of_casualties AS casualties,
                 cast(date AS string) AS date, speed_limit FROM collision WHERE collision_index LIKE '%77%' AND collision_severity = 3""", "collision")
def search_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = serving.search_collisions(view(spark, sf_dir, "collision"), " 77 ", severity=3)
    return serving.collision_records(found).select("collision_id", "year", "severity", "severity_label", "vehicles", "casualties", "date", "speed_limit")


@query("SELECT segment_id, road_number FROM link WHERE lower(road_number) LIKE '%brand#1%' OR lower(segment_id) LIKE '%brand#1%'", "link")
def search_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.search_segments(view(spark, sf_dir, "link"), "BRAND#1").select("segment_id", "road_number")


@query("""SELECT count(*) AS collisions, count_if(collision_severity IN (1, 2)) AS ksi_collisions, cast(sum(number_of_casualties) AS bigint) AS casualties, count_if(collision_severity = 1) AS fatal,
                 count_if(collision_severity = 2) AS serious, count_if(collision_severity = 3) AS slight FROM collision""", "collision")
def collision_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.collision_summary(view(spark, sf_dir, "collision"))


@query("""SELECT count(*) AS segments, count(all_motor_vehicles) AS segments_with_exposure, count_if(estimation_method = 'Counted') AS counted_segments,
                 count_if(estimation_method = 'Estimated') AS estimated_segments, cast(sum(collision_count) AS bigint) AS matched_collisions, cast(sum(ksi_count) AS bigint) AS matched_ksi
          FROM panel WHERE year = 1996""", "panel")
def network_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.network_summary(view(spark, sf_dir, "panel").where("year = 1996"))


def _counts_as_long(sql: str) -> str:
    """count_if() gives a wider type in some engines; compared as a long."""
    out, at = "", 0
    while (start := sql.find("count_if(", at)) >= 0:
        depth, end = 1, start + len("count_if(")
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        out += sql[at:start] + f"cast({sql[start:end]} AS bigint)"
        at = end
    return out + sql[at:]


from . import stored  # noqa: E402,F401  (adds its queries to the registry)

ORACLES = {k: _counts_as_long(v) for k, v in ORACLES.items()}
