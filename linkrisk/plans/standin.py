"""Stand-ins for the library's input tables, derived from general-purpose tables.

Each is one SQL text that Spark and other engines run alike; names in braces are tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.panel import Contract

CONTRACT = Contract((1995, 1996, 1997, 1998), (1999,), (2000,), ("road_category", "urban_rural", "local_authority"))

VIEWS = {
    "collision": """
        SELECT cast(o_orderkey AS string) AS collision_index, cast(year(o_orderdate) AS int) AS collision_year,
               CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1 WHEN '2' THEN 2 ELSE 3 END AS collision_severity,
               cast(1 + o_orderkey % 3 AS int) AS number_of_vehicles, cast(1 + o_orderkey % 2 AS int) AS number_of_casualties,
               cast(o_orderdate AS date) AS date, '00:00' AS time, cast(20 + 10 * (o_orderkey % 6) AS int) AS speed_limit,
               cast(o_custkey % 25 AS string) AS local_authority_highway_current,
               cast(-2 AS double) + cast(o_orderkey % 900 AS double) / 1000 AS longitude,
               CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE cast(53 AS double) + cast(o_orderkey % 700 AS double) / 1000 END AS latitude,
               cast(400000 + (o_orderkey * 7919) % 40000 AS double) AS x, cast(420000 + (o_orderkey * 10473) % 20000 AS double) AS y
        FROM {orders}""",
    "link": """
        SELECT concat('seg-', cast(p_partkey AS string)) AS segment_id, p_partkey AS count_point_id, p_brand AS road_number,
               p_type AS road_category, concat('type-', cast(p_partkey % 3 AS string)) AS road_type,
               cast(p_partkey % 25 AS string) AS local_authority_code,
               CASE WHEN p_partkey % 97 = 0 THEN NULL WHEN p_size <= 25 THEN 'urban' ELSE 'rural' END AS urban_rural,
               cast(400000 + (p_partkey * 6151) % 40000 AS double) AS x1, cast(420000 + (p_partkey * 3571) % 20000 AS double) AS y1,
               cast(400000 + (p_partkey * 6151) % 40000 + 300 + (p_partkey % 7) * 100 AS double) AS x2,
               cast(420000 + (p_partkey * 3571) % 20000 + ((p_partkey % 5) - 2) * 150 AS double) AS y2
        FROM {part}""",
    "traffic": """
        SELECT l_partkey AS count_point_id, cast(year(l_shipdate) AS int) AS year, cast(100 * sum(l_quantity) AS bigint) AS all_motor_vehicles,
               cast(300 + (l_partkey % 7) * 100 AS double) / 1000 AS link_length_km,
               CASE WHEN (l_partkey + year(l_shipdate)) % 4 = 0 THEN 'Counted' ELSE 'Estimated' END AS estimation_method
        FROM {lineitem} GROUP BY l_partkey, year(l_shipdate)""",
    "panel": """
        SELECT concat('dft-count-point-', cast(t.p AS string)) AS segment_key, concat('dft-mrdb-', cast(t.y AS string), '-', cast(t.p AS string)) AS segment_id,
               t.p AS count_point_id, t.y AS source_year, t.y AS year, s.p_brand AS road_number, s.p_type AS road_category,
               concat('type-', cast(t.p % 3 AS string)) AS road_type, cast(t.p % 25 AS int) AS local_authority_id, n.n_name AS local_authority_name,
               CASE WHEN t.y = 2000 AND t.p % 50 = 49 THEN '99' ELSE cast(t.p % 25 AS string) END AS local_authority_code,
               CASE WHEN (t.p + t.y) % 4 = 0 THEN 'Counted' ELSE 'Estimated' END AS estimation_method,
               t.flow AS all_motor_vehicles, cast(300 + (t.p % 7) * 100 AS double) / 1000 AS link_length_km,
               t.flow * 365 * (cast(300 + (t.p % 7) * 100 AS double) / 1000) AS annual_vehicle_km,
               t.collisions AS collision_count, t.ksi AS ksi_count,
               CASE WHEN t.p % 97 = 0 THEN NULL WHEN s.p_size <= 25 THEN 'urban' ELSE 'rural' END AS urban_rural
        FROM (SELECT l_partkey AS p, cast(year(l_shipdate) AS int) AS y, cast(100 * sum(l_quantity) AS bigint) AS flow,
                     cast(sum(CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_orderkey % 5 = 0 THEN 5 ELSE 1 END ELSE 0 END) AS bigint) AS collisions,
                     cast(sum(CASE WHEN l_returnflag = 'R' AND l_quantity > 25 THEN CASE WHEN l_orderkey % 5 = 0 THEN 5 ELSE 1 END ELSE 0 END) AS bigint) AS ksi
              FROM {lineitem} GROUP BY l_partkey, year(l_shipdate)) t
        JOIN {part} s ON s.p_partkey = t.p JOIN {nation} n ON n.n_nationkey = t.p % 25""",
    "area": """
        SELECT cast(n_nationkey AS string) AS area_id, cast(404000 + (n_nationkey % 5) * 8000 AS double) AS cx,
               cast(422000 + cast((n_nationkey - n_nationkey % 5) / 5 AS int) * 4000 AS double) AS cy,
               CASE WHEN n_regionkey % 2 = 0 THEN 'urban' ELSE 'rural' END AS urban_rural
        FROM {nation}""",
    "edge": """
        SELECT area_id, k, cx + CASE k WHEN 0 THEN 3500 WHEN 2 THEN -3500 ELSE 0 END AS x1, cy + CASE k WHEN 1 THEN 1500 WHEN 3 THEN -1500 ELSE 0 END AS y1,
               cx + CASE k WHEN 3 THEN 3500 WHEN 1 THEN -3500 ELSE 0 END AS x2, cy + CASE k WHEN 0 THEN 1500 WHEN 2 THEN -1500 ELSE 0 END AS y2
        FROM {area} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) AS corners""",
}
TABLES = {"collision": ["orders"], "link": ["part"], "traffic": ["lineitem"], "panel": ["lineitem", "part", "nation"], "area": ["nation"], "edge": ["area"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tables = {t: view(spark, sf_dir, t) if t in VIEWS else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES[name]}
    return spark.sql(VIEWS[name], **tables)


def sql_with(body: str, *names: str) -> str:
    """``body`` as SQL over plain tables, with the views as common table expressions."""
    need: list[str] = []
    for n in names:
        need += [*(t for t in TABLES[n] if t in VIEWS and t not in need), *([n] if n not in need else [])]
    parts = [f"{n} AS ({VIEWS[n].format(**{t: t for t in TABLES[n]})})" for n in need]
    return "WITH " + ", ".join(parts) + " " + body
