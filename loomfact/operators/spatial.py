"""Placed points against spatial constraints, contradictions, and roads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Directions as (dx, dy) of the target seen from the source; y grows downwards.
DIRECTIONS = {"north": (0, -1), "south": (0, 1), "east": (1, 0), "west": (-1, 0)}
OPPOSITE = {"north": "south", "south": "north", "east": "west", "west": "east"}


def placed(constraints: DataFrame, points: DataFrame) -> DataFrame:
    """Constraints (source, target) with both points' coordinates (name, x, y)."""
    s = points.select(F.col("name").alias("source"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    t = points.select(F.col("name").alias("target"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return constraints.join(s, "source").join(t, "target")


def satisfied(constraints: DataFrame, points: DataFrame, near: float, radius: float) -> DataFrame:
    """Each constraint with whether its points meet it: direction, adjacent, separated, contains."""
    p = placed(constraints, points)
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    far = F.sqrt(dx * dx + dy * dy)
    lean = F.coalesce(*(F.when(F.col("value") == k, dx * a + dy * b > 0) for k, (a, b) in DIRECTIONS.items()), F.lit(False))
    kind = F.col("relation_type")
    ok = F.when(kind == "direction", lean).when(kind == "adjacent", far <= near).when(kind == "separated", far > near).when(kind == "contains", far <= radius).otherwise(False)
    return p.select(*constraints.columns, ok.alias("ok"))


def satisfaction(constraints: DataFrame, points: DataFrame, near: float, radius: float) -> DataFrame:
    """Constraints and satisfied ones of each kind."""
    return satisfied(constraints, points, near, radius).groupBy("relation_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("met"))


def direction_energy(constraints: DataFrame, points: DataFrame) -> DataFrame:
    """Sum of squared distances by which directions are missed, by confidence."""
    p = placed(constraints.where("relation_type = 'direction'"), points)
    dx, dy = F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")
    along = F.coalesce(*(F.when(F.col("value") == k, dx * a + dy * b) for k, (a, b) in DIRECTIONS.items()), F.lit(0.0))
    return p.withColumn("miss", F.greatest(F.lit(0.0), -along)).groupBy("confidence").agg(F.sum(F.col("miss") * F.col("miss")).alias("energy"))


def without_contradictions(constraints: DataFrame, rank: str, pos: str) -> DataFrame:
    """Of contradictory directions of a pair the one of higher rank stays, the first on a tie."""
    opposite = F.create_map(*(F.lit(x) for kv in OPPOSITE.items() for x in kv))
    turned = F.when(F.col("source") > F.col("target"), opposite[F.col("value")]).otherwise(F.col("value"))
    axis = F.when(turned.isin("north", "south"), "ns").otherwise("ew")
    rows = constraints.withColumns({"__a": F.least("source", "target"), "__b": F.greatest("source", "target"), "__d": turned, "__x": axis})
    best = rows.groupBy("__a", "__b", "__x").agg(F.max_by("__d", F.struct(F.col(rank), -F.col(pos))).alias("__best"))
    return rows.join(best, ["__a", "__b", "__x"]).where("__d = __best").select(*constraints.columns)


def roads(points: DataFrame, group: str) -> DataFrame:
    """Minimum spanning tree of each group's points: (group, a, b, length).

    A group is the places of one novel's layer (tens of points), so Prim's rounds run in a grouped map.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("name").reset_index(drop=True)
        xy = pdf[["x", "y"]].to_numpy(float)
        near, at, out = np.full(len(xy), np.inf), np.zeros(len(xy), int), []
        inside = np.zeros(len(xy), bool)
        now = 0
        for _ in range(len(xy) - 1):
            inside[now] = True
            d = np.hypot(*(xy - xy[now]).T)
            closer = (d < near) & ~inside
            near[closer], at[closer] = d[closer], now
            now = int(np.where(inside, np.inf, near).argmin())
            out.append((pdf[group][0], pdf["name"][at[now]], pdf["name"][now], float(near[now])))
        return pd.DataFrame(out, columns=[group, "a", "b", "length"])

    kinds = dict(points.dtypes)
    return points.select(group, "name", "x", "y").groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, a {kinds['name']}, b {kinds['name']}, length double")
