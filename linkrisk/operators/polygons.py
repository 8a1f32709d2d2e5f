"""Points in areas, by grid cells; areas are given as the straight pieces of their rings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import cells_between, piece_distance
from ..sources.shared import stored
from .matching import CELL, within_distance


#: Edges that a slab of an area has on average, if none is much higher than others.
SLAB_EDGES = 8


def in_area(points: DataFrame, edges: DataFrame, *, point_id: str, area_id: str = "area_id", cell: float = CELL, tolerance: float = 1e-9) -> DataFrame:
    """point_id and area_id of all areas that cover a point; their border counts.

    points: point_id, x, y; edges: area_id, x1, y1, x2, y2. The bounding box of an area chooses its
    candidates by cells; the crossings of a ray decide. Each area is cut in slabs of equal height, and
    an edge is entered in every slab that it touches, so a point meets only the edges of its own slab.
    Slabs are as high as the mean edge at least, so that edges have two entries on average at most.
    """
    rise = F.abs(F.col("y2") - F.col("y1"))
    boxes = edges.groupBy(area_id).agg(
        F.least(F.min("x1"), F.min("x2")).alias("_a"), F.greatest(F.max("x1"), F.max("x2")).alias("_b"), F.least(F.min("y1"), F.min("y2")).alias("_c"), F.greatest(F.max("y1"), F.max("y2")).alias("_d"),
        F.count(F.lit(1)).alias("_n"), F.avg(rise).alias("_rise"),
    )
    high = F.greatest((F.col("_d") - F.col("_c")) * SLAB_EDGES / F.col("_n"), "_rise")
    boxes = boxes.withColumn("_high", F.when(high > 0, high).otherwise(1.0)).drop("_n", "_rise")
    slab = lambda y: F.floor((y - F.col("_c")) / F.col("_high")).cast("long")
    slabs = edges.select(area_id, "x1", "y1", "x2", "y2").join(boxes.select(area_id, "_c", "_high"), area_id)
    slabs = slabs.withColumn("_slab", F.explode(F.sequence(slab(F.least("y1", "y2") - tolerance), slab(F.greatest("y1", "y2") + tolerance)))).drop("_c", "_high")
    spread = boxes.withColumn("_cx", F.explode(cells_between(F.col("_a"), F.col("_b"), cell))).withColumn("_cy", F.explode(cells_between(F.col("_c"), F.col("_d"), cell)))
    at = points.where("x is not null and y is not null").select(point_id, "x", "y", F.floor(F.col("x") / cell).cast("long").alias("_cx"), F.floor(F.col("y") / cell).cast("long").alias("_cy"))
    near = at.join(spread, ["_cx", "_cy"]).where("x between _a and _b and y between _c and _d").select(point_id, "x", "y", area_id, slab(F.col("y")).alias("_slab"))
    x, y, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    rises = (y1 > y) != (y2 > y)
    crosses = rises & (x < F.when(rises, (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1) + x1))
    border = piece_distance(x, y, x1, y1, x2, y2) <= tolerance
    hit = near.join(slabs, [area_id, "_slab"]).groupBy(point_id, area_id).agg(F.sum(F.when(crosses, 1).otherwise(0)).alias("_n"), F.max(border).alias("_on"))
    return hit.where("_on or _n % 2 = 1").select(point_id, area_id)


def classify(points: DataFrame, edges: DataFrame, classes: DataFrame, *, point_id: str, area_id: str = "area_id", max_distance: float = 500.0) -> DataFrame:
    """The class (urban or rural) of every point: of the first covering area by id that has one, else of the
    nearest area within ``max_distance``, else null. An area that covers a point is the nearest, at distance 0: in
    one without a class a point has none, whatever lies beside it."""
    known = classes.where(F.col("urban_rural").isin("urban", "rural")).select(area_id, "urban_rural")
    covered = in_area(points, edges, point_id=point_id, area_id=area_id).join(known, area_id, "left")
    own = covered.groupBy(point_id).agg(F.min(F.when(F.col("urban_rural").isNotNull(), F.struct(area_id, "urban_rural"))).alias("_c"))
    own = stored(own.select(point_id, F.col("_c.urban_rural").alias("_own")), "covered")  # it serves the result and the rest
    rest = points.join(own, point_id, "left_anti")
    near = within_distance(rest, edges, max_distance, point_id=point_id, line_id=area_id).groupBy(point_id).agg(F.min(F.struct("distance", area_id)).alias("_n"))
    near = near.select(point_id, F.col(f"_n.{area_id}").alias(area_id)).join(known, area_id).select(point_id, F.col("urban_rural").alias("_near"))
    return points.select(point_id).distinct().join(own, point_id, "left").join(near, point_id, "left").select(point_id, F.coalesce("_own", "_near").alias("urban_rural"))
