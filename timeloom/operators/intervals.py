"""Interval algebra on (rec, a, b) tables: everything is keyed by ``rec`` and, where it joins, by time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(spans: DataFrame) -> DataFrame:
    """(rec, island, a, b): overlapping and touching intervals made one; null or empty ones are left out."""
    order = Window.partitionBy("rec").orderBy("a", "b")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.where("b > a").select("rec", "a", "b").withColumn("furthest", F.max("b").over(before))
    rows = rows.withColumn("island", F.sum(F.when(F.col("a") <= F.col("furthest"), 0).otherwise(1)).over(order) - 1)
    return rows.groupBy("rec", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))


def complement(spans: DataFrame, extents: DataFrame | None = None) -> DataFrame:
    """(rec, a, b): the holes between islands, and before and behind them within ``extents`` (rec, low, high)."""
    islands = union(spans)
    order = Window.partitionBy("rec").orderBy("a")
    holes = islands.select("rec", F.lag("b").over(order).alias("a"), F.col("a").alias("b")).where("a IS NOT NULL AND b > a")
    if extents is None:
        return holes
    edges = extents.join(islands.groupBy("rec").agg(F.min("a").alias("first"), F.max("b").alias("last")), "rec", "left")
    head = edges.select("rec", F.col("low").alias("a"), F.coalesce("first", "high").alias("b"))
    tail = edges.where("last IS NOT NULL").select("rec", F.col("last").alias("a"), F.col("high").alias("b"))
    return holes.unionByName(head).unionByName(tail).where("b > a")


def subtract(spans: DataFrame, cuts: DataFrame, least: int = 0, width: int = 7_200_000) -> DataFrame:
    """(…, a, b): each interval without the union of ``cuts``, in pieces longer than ``least``; other columns stay.

    An interval meets the islands of the cuts in time buckets. Islands are apart, so each gives
    the piece behind it, up to the next island, and the first one the piece before it. Nothing
    is gathered by recording or interval, and repeated rows give their pieces again.
    """
    order = Window.partitionBy("rec").orderBy("a")
    islands = union(cuts).select("rec", F.col("a").alias("c"), F.col("b").alias("d"), F.lag("b").over(order).alias("before"), F.lead("a").over(order).alias("after"))
    rows, gone = spans.where("b > a"), _bucketed(islands, F.col("c"), F.col("d"), width).alias("y")
    wide = _bucketed(rows, F.col("a"), F.col("b"), width).alias("x")
    meet = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("y.c") < F.col("x.b")) & (F.col("y.d") > F.col("x.a"))
    met = wide.join(gone, meet & (F.col("x.bucket") == F.floor(F.greatest("x.a", "y.c") / width)))
    head = F.when(F.coalesce(F.col("y.before") <= F.col("x.a"), F.lit(True)), F.struct(F.col("x.a").alias("a"), F.col("y.c").alias("b")))
    rest = F.struct(F.col("y.d").alias("a"), F.least("x.b", F.coalesce("y.after", "x.b")).alias("b"))
    others = [c for c in spans.columns if c not in ("a", "b")]
    pieces = met.select(*[F.col(f"x.`{c}`") for c in others], F.explode(F.array_compact(F.array(head, rest))).alias("piece")).select(*[F.col(f"`{c}`") for c in others], "piece.a", "piece.b")
    # intervals that no island meets in any of their buckets stay whole
    touched = met.select(F.col("x.rec").alias("rec"), F.col("x.a").alias("a"), F.col("x.b").alias("b")).distinct().alias("t")
    whole = rows.alias("x").join(touched, (F.col("x.rec") == F.col("t.rec")) & (F.col("x.a") == F.col("t.a")) & (F.col("x.b") == F.col("t.b")), "left_anti")
    return pieces.unionByName(whole.select(*[F.col(f"`{c}`") for c in others], "a", "b")).where(F.col("b") - F.col("a") > least)


def _bucketed(df: DataFrame, low: Column, high: Column, width: int) -> DataFrame:
    return df.withColumn("bucket", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))


def points_in(points: DataFrame, spans: DataFrame, at: str = "t", width: int = 7_200_000, keep: bool = True) -> DataFrame:
    """Points (rec, at, …) that lie in any closed interval, or in none with ``keep`` false; equi-joined by time bucket."""
    held = _bucketed(spans.where("b >= a").select("rec", "a", "b"), F.col("a"), F.col("b"), width)
    left, right = points.withColumn("bucket", F.floor(F.col(at) / width)).alias("x"), held.alias("y")
    on = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & F.col(f"x.{at}").between(F.col("y.a"), F.col("y.b"))
    return left.join(right, on, "left_semi" if keep else "left_anti").drop("bucket")


def overlaps(left: DataFrame, right: DataFrame, width: int = 7_200_000) -> DataFrame:
    """Pairs of intervals (rec, id, a, b) of one recording that share more than an end: id, other, and whether the left one is inside.

    Each pair is found in the bucket where its overlap starts, so none comes twice.
    """
    x = _bucketed(left.select("rec", "id", "a", "b"), F.col("a"), F.col("b"), width).alias("x")
    y = _bucketed(right.select("rec", "id", "a", "b"), F.col("a"), F.col("b"), width).alias("y")
    on = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.a") < F.col("y.b")) & (F.col("y.a") < F.col("x.b"))
    first = F.col("x.bucket") == F.floor(F.greatest("x.a", "y.a") / width)
    inside = (F.col("x.a") >= F.col("y.a")) & (F.col("x.b") <= F.col("y.b"))
    return x.join(y, on & first).select("x.rec", "x.id", F.col("y.id").alias("other"), F.when(inside, "inside").otherwise("straddles").alias("relation"))


def nearest(points: DataFrame, marks: DataFrame, reach: int) -> DataFrame:
    """Points (rec, id, t) with the nearest mark (rec, mark, at) within ``reach``; of equal distances the last mark wins."""
    x = points.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("t") - reach) / reach), F.floor((F.col("t") + reach) / reach)))).alias("x")
    y = marks.withColumn("bucket", F.floor(F.col("at") / reach)).alias("y")
    away = F.abs(F.col("x.t") - F.col("y.at"))
    met = x.join(y, (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & (away <= reach))
    met = met.select("x.rec", "x.id", "y.mark", "y.at", away.alias("away"))
    return met.groupBy("rec", "id").agg(F.max_by("mark", F.struct(-F.col("away"), F.col("at"), F.col("mark"))).alias("mark"), F.min("away").alias("away"))


def around(points: DataFrame, marks: DataFrame) -> DataFrame:
    """Points (rec, id, t) with the last mark at or before them and the first one after: one window over both."""
    rows = points.select("rec", "id", "t", F.lit(None).cast("long").alias("at")).unionByName(marks.select("rec", F.lit(None).cast("long").alias("id"), F.col("at").alias("t"), "at"))
    order = Window.partitionBy("rec").orderBy("t", F.col("at").isNull())
    previous = F.last("at", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    following = F.first("at", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
    return rows.withColumn("previous", previous).withColumn("following", following).where("id IS NOT NULL").select("rec", "id", "previous", "following")


def free_gap(points: DataFrame, spans: DataFrame, total: DataFrame) -> DataFrame:
    """The hole (gap_a, gap_b) of each recording that a point (rec, id, t) falls in; no row for a point inside a span.

    Holes are apart, so a point can only be in the one that began last: one window over both.
    """
    holes = complement(spans, total).select("rec", F.lit(None).cast(points.schema["id"].dataType).alias("id"), F.col("a").alias("t"), F.struct("a", "b").alias("hole"), F.lit(0).alias("asks"))
    rows = points.select("rec", "id", "t", F.lit(None).cast(holes.schema["hole"].dataType).alias("hole"), F.lit(1).alias("asks")).unionByName(holes)
    begun = F.last("hole", ignorenulls=True).over(Window.partitionBy("rec").orderBy("t", "asks").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("hole", begun).where("asks = 1 AND t < hole.b").select("rec", "id", F.col("hole.a").alias("gap_a"), F.col("hole.b").alias("gap_b"))


def tiles(placed: DataFrame, gap_least: int = 800, residual: int = 280, speed: int = 3, least: int = 20) -> DataFrame:
    """(rec, ord, a, b, speed): placed spans (rec, ord, a, b, hold) with the gaps between them sped up.

    A gap of ``gap_least`` or more is glided but for its last ``residual``, unless it is the
    first or the line before holds it. Tiles never overlap; neighbours of one speed are one.
    """
    order = Window.partitionBy("rec").orderBy("ord")
    end = F.coalesce(F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = F.coalesce(F.lag("hold").over(order), F.lit(True))
    rows = placed.withColumn("e", end).withColumn("held", held)
    gap = F.col("a") - F.col("e")
    glide = ~F.col("held") & (gap >= gap_least)
    cut = F.greatest(F.col("e"), F.col("a") - residual)
    tile = lambda a, b, v, ok: F.when(ok, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), F.lit(v).alias("speed")))
    start = F.greatest(F.col("a"), F.col("e"))
    made = F.array_compact(F.array(
        tile(F.col("e"), cut, speed, glide & (cut - F.col("e") > 10)),
        tile(cut, F.col("a"), 1, glide & (F.col("a") > cut)),
        tile(F.col("e"), F.col("a"), 1, ~glide & (gap > 10)),
        tile(start, F.greatest(F.col("b"), start), 1, F.col("b") > start),
    ))
    flat = rows.select("rec", "ord", F.posexplode(made).alias("nth", "t")).select("rec", "ord", "nth", "t.*")
    order = Window.partitionBy("rec").orderBy("a", "b", "ord", "nth")
    fresh = ~((F.lag("speed").over(order) == F.col("speed")) & (F.lag("b").over(order) == F.col("a")))
    flat = flat.withColumn("fresh", F.coalesce(fresh, F.lit(True))).withColumn("run", F.sum(F.col("fresh").cast("int")).over(order))
    merged = flat.groupBy("rec", "run").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.first("speed").alias("speed")).where(F.col("b") - F.col("a") > least)
    return merged.select("rec", (F.row_number().over(Window.partitionBy("rec").orderBy("a")) - 1).cast("long").alias("ord"), "a", "b", "speed")


def remap(points: DataFrame, tiles: DataFrame, scale: int = 6) -> DataFrame:
    """Points (rec, id, t) on the output clock of ``tiles``, in 1/scale ms (whole for speeds that divide it).

    Inside a tile: what lies before it plus the offset over its speed; in a hole: what lies before.
    """
    length = ((F.col("b") - F.col("a")) * scale / F.col("speed")).cast("long")
    order = Window.partitionBy("rec").orderBy("a")
    begun = tiles.withColumn("done", F.sum(length).over(order) - length).select("rec", F.col("a").alias("t"), F.struct("a", "b", "speed", "done").alias("tile"), F.lit(None).cast("long").alias("id"))
    rows = points.select("rec", "t", F.lit(None).cast(begun.schema["tile"].dataType).alias("tile"), "id").unionByName(begun)
    seen = F.last("tile", ignorenulls=True).over(Window.partitionBy("rec").orderBy("t", F.col("tile").isNull()).rowsBetween(Window.unboundedPreceding, 0))
    at = F.least("t", "tile.b") - F.col("tile.a")
    out = F.coalesce(F.col("tile.done") + (at * scale / F.col("tile.speed")).cast("long"), F.lit(0).cast("long"))
    return rows.withColumn("tile", seen).where("id IS NOT NULL").select("rec", "id", out.alias("out"))


def cascade(lines: DataFrame, room: int = 120) -> DataFrame:
    """(…, at): each line not before the one ahead of it is over, with ``room`` between; locked lines reset that.

    The closed form of the running maximum: inside a block between locked lines, at = P + max(seed, max(start - P))
    with P the lengths, holds and rooms before. Dropped lines are left out.
    """
    order = Window.partitionBy("rec").orderBy("ord")
    live = lines.where("NOT dropped").withColumn("block", F.sum(F.col("locked").cast("int")).over(order))
    inner = Window.partitionBy("rec", "block").orderBy("ord")
    seed = F.first(F.when(F.col("locked"), F.col("end"))).over(inner)
    live = live.withColumn("seed", F.coalesce(seed, F.lit(0)) + room)
    free = Window.partitionBy("rec", "block", "locked").orderBy("ord")
    step = F.col("len") + F.col("hold") + room
    live = live.withColumn("before", F.sum(step).over(free) - step)
    best = F.max(F.col("start") - F.col("before")).over(free)
    at = F.when(F.col("locked"), F.col("start")).otherwise(F.col("before") + F.greatest("seed", best))
    return live.withColumn("at", at).drop("block", "seed", "before")
