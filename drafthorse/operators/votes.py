"""Votes of terminals for line types, and what a group of them resolves to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BIND = 36.0
MAX_FALLBACK = 12.0
MAX_CENTER = 48.0


def tally(rows: DataFrame, by: list[str], number: str = "line_type_number", distance: str = "distance") -> DataFrame:
    return rows.groupBy(*by, number).agg(F.count(F.lit(1)).alias("votes"), F.sum(distance).alias("weight"))


def winners(votes: DataFrame, by: list[str], number: str = "line_type_number") -> DataFrame:
    """The number of most votes, then least summed distance, then least number; tied: another has as many votes."""
    w = Window.partitionBy(*by)
    rank = F.row_number().over(w.orderBy(F.desc("votes"), "weight", number))
    most = F.sum((F.col("votes") == F.col("__most")).cast("int")).over(w)
    x = votes.withColumn("__most", F.max("votes").over(w)).withColumn("tied", most > 1).withColumn("__rank", rank)
    return x.filter("__rank = 1").drop("__rank", "__most")


def verdicts(rows: DataFrame) -> DataFrame:
    """state and number of each terminal, from (distance, owner, owned_distance, owned_owner, is_center)."""
    center = F.col("is_center") & F.col("owned_owner").isNotNull() & F.col("owned_distance").isNotNull()
    near = F.col("owned_distance") <= MAX_FALLBACK
    state = (
        F.when(center & (F.col("owned_distance") <= MAX_CENTER), "bound").when(center, "too-far").when(F.col("distance").isNull(), "no-geometry")
        .when(F.col("distance") > MAX_BIND, "too-far").when(F.col("owner").isNotNull(), "bound")
        .when(F.col("owned_owner").isNotNull() & near, "bound").otherwise("residual")
    )
    number = F.when(center, F.col("owned_owner")).otherwise(F.coalesce("owner", "owned_owner"))
    return rows.withColumn("state", state).withColumn("number", F.when(F.col("state") == "bound", number))


def group_binding(judged: DataFrame, by: list[str]) -> DataFrame:
    """Each terminal with its group's winner, and whether it was reassigned to it."""
    bound = judged.filter("state = 'bound'")
    won = winners(tally(bound, by, "number"), by, "number").select(*by, F.col("number").alias("winner"), "votes", "tied")
    x = judged.join(won, by, "left")
    moved = (F.col("state") == "bound") & (F.col("number") != F.col("winner"))
    return x.withColumn("final_state", F.when(moved, "reassigned").otherwise(F.col("state")))


def center_winners(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, center, confirmed) of (by, placement, number, distance): the number that most placements reach, then the one
    that is first for most, then nearest in sum (hundredths), then least; confirmed: at least two placements.
    """
    c = rows.groupBy(*by, "placement", "number").agg(F.min(F.round(F.col("distance") * 100).cast("long")).alias("d"))
    first = F.row_number().over(Window.partitionBy(*by, "placement").orderBy("d", "number")) == 1
    t = c.withColumn("first", first).groupBy(*by, "number").agg(F.count(F.lit(1)).alias("coverage"), F.count_if("first").alias("first_votes"), F.sum("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("coverage"), F.desc("first_votes"), "d", "number"))
    return t.withColumn("rank", rank).filter("rank = 1").select(*by, F.col("number").alias("center"), (F.col("coverage") >= 2).alias("confirmed"))


def resolve(rows: DataFrame, geometry_up_to: int) -> tuple[DataFrame, DataFrame]:
    """(groups, terminals) at read time, from (grp, number, distance, gate, in_plan, kind, state, placement).

    Bound terminals in the plan vote. A gate has no winner; nor has a group whose legend samples disagree. Samples that
    agree win outright, else the arrows' winner stands, which a centre may replace if it is all there is, or if it is
    confirmed and at most one arrow says otherwise. A winner whose geometry is not stored is reported as missing.
    """
    inside = rows.filter("in_plan and state = 'bound'")
    arrows = tally(inside.filter("kind = 'arrow'"), ["grp"], "number")
    arrow = winners(arrows, ["grp"], "number").select("grp", F.col("number").alias("arrow"))
    legend = inside.filter("kind = 'legend'").groupBy("grp").agg(F.min("number").alias("low"), F.max("number").alias("high"))
    center = center_winners(inside.filter("kind = 'center'"), ["grp"])
    others = arrows.join(center, "grp").filter("number <> center").groupBy("grp").agg(F.sum("votes").alias("others"))
    g = rows.select("grp", "gate").distinct()
    for one in (legend, arrow, center, others):
        g = g.join(one, "grp", "left")
    conflict = F.coalesce(F.col("low") != F.col("high"), F.lit(False))
    arrow_, center_ = F.col("arrow"), F.col("center")
    with_center = (
        F.when(center_.isNull(), arrow_).when(arrow_ == center_, center_).when(~F.col("confirmed"), F.coalesce(arrow_, center_))
        .when(arrow_.isNull() | (F.coalesce("others", F.lit(0)) <= 1), center_).otherwise(arrow_)
    )
    picked = F.when(F.col("gate") | conflict, None).when(F.col("low").isNotNull(), F.col("low")).otherwise(with_center)
    g = g.select("grp", "gate", F.col("low").isNotNull().alias("has_legend"), conflict.alias("conflict"), picked.alias("picked"))
    stored = F.col("picked") <= geometry_up_to
    g = g.select("grp", "gate", "has_legend", "conflict", F.when(stored, F.col("picked")).alias("winner"), F.when(~stored, F.col("picked")).alias("missing"))
    x = rows.drop("gate").join(g, "grp")
    near = (F.abs(F.col("number") - F.col("winner")) <= 1) & (F.col("distance") <= MAX_BIND)
    final = (
        F.when(F.col("gate"), "gate").when(F.col("state") != "bound", F.col("state")).when(F.col("winner").isNull(), "hidden")
        .when(F.col("number") == F.col("winner"), "bound").when(near, "reassigned").otherwise("unresolved")
    )
    x = x.withColumn("final_state", final)
    return g, x.withColumn("visible", F.col("in_plan") & F.col("final_state").isin("bound", "reassigned"))
