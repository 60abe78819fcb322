"""What holds at an instant and how far lines may be moved: open and closed meetings, refused slices, room between neighbours, gaps around words, profiles of clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import _bucketed, points_in


def at_point(points: DataFrame, spans: DataFrame, at: str = "t", open_ends: bool = False, first: bool = False, width: int = 7_200_000) -> DataFrame:
    """Points (rec, at, …) with the ``span`` (its id) of each interval (rec, id, a, b) that holds them, or only the first by beginning and id.

    With ``open_ends`` an interval does not hold its own ends. Points and intervals meet in buckets of time; points that nothing holds are left out.
    """
    held = _bucketed(spans.where("b >= a").select("rec", "id", "a", "b"), F.col("a"), F.col("b"), width).alias("y")
    rows = points.withColumn("bucket", F.floor(F.col(at) / width)).alias("x")
    t, a, b = F.col(f"x.{at}"), F.col("y.a"), F.col("y.b")
    inside = (t > a) & (t < b) if open_ends else t.between(a, b)
    met = rows.join(held, (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & inside)
    columns = [F.col(f"x.`{c}`") for c in points.columns]
    if not first:
        return met.select(*columns, F.col("y.id").alias("span"))
    return met.groupBy(*columns).agg(F.min(F.struct("y.a", "y.id")).alias("_f")).select(*points.columns, F.col("_f.id").alias("span"))


def slice_verdicts(asked: DataFrame, slices: DataFrame, blocks: DataFrame, cuts: DataFrame, ends: DataFrame, near: int = 50) -> DataFrame:
    """(rec, id, at, why) of asked slices (rec, id, at): refused within a block or a cut, at an ``edge`` of the recording (rec, total), or ``near`` one that is there; null where it is new.

    Blocks (rec, id, a, b) do not hold their ends, cuts do.
    """
    named = lambda df, why: df.select("rec", "id", "at").distinct().withColumn(why, F.lit(True))
    block = named(at_point(asked, blocks, "at", open_ends=True), "_block")
    cut = named(points_in(asked, cuts, "at"), "_cut")
    width = 2 * near
    reach = F.sequence(F.floor((F.col("at") - near) / width), F.floor((F.col("at") + near) / width))
    x, y = asked.withColumn("bucket", F.floor(F.col("at") / width)).alias("x"), slices.select("rec", "at", F.explode(reach).alias("bucket")).alias("y")
    close = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.abs(F.col("x.at") - F.col("y.at")) < near)
    there = named(x.join(y, close, "left_semi"), "_near")
    key = ["rec", "id", "at"]
    rows = asked.select(*key).join(block, key, "left").join(cut, key, "left").join(there, key, "left").join(ends.select("rec", "total"), "rec", "left")
    edge = (F.col("at") < near) | (F.col("at") > F.col("total") - near)
    return rows.select(*key, F.when(F.col("_block"), "block").when(F.col("_cut"), "cut").when(edge, "edge").when(F.col("_near"), "near").alias("why"))


def line_bounds(lines: DataFrame, margin: int = 20, least_over: int = 60) -> DataFrame:
    """(rec, id, least, most, over, room_permille) of live lines (rec, ord, id, start, end, len, hold, offset, dropped): how far each may be moved
    earlier and later, by how much it runs into the next, and how far it may be stretched.

    A line lies at start + offset for ``len``, or as long as it was spoken where that is 0, and holds for ``hold``; the recording ends with its last line.
    """
    live = lines.where(~F.col("dropped"))
    placed = F.col("start") + F.coalesce("offset", F.lit(0))
    length = F.when(F.coalesce("len", F.lit(0)) > 0, F.col("len")).otherwise(F.col("end") - F.col("start"))
    order = Window.partitionBy("rec").orderBy("ord")
    rows = live.select("rec", "id", "ord", "start", placed.alias("placed"), length.alias("length"), (placed + length + F.coalesce("hold", F.lit(0))).alias("block_end"), F.max("end").over(Window.partitionBy("rec")).alias("extent"))
    before, after, after_start = F.lag("block_end").over(order), F.lead("placed").over(order), F.lead("start").over(order)
    low = F.coalesce(before + margin, F.lit(0)) - F.col("start")
    high = F.coalesce(F.greatest(after, after_start) - margin, F.col("extent")) - F.col("start") - F.col("length")
    over = F.when(after.isNotNull(), F.col("block_end") - F.greatest(after, F.lit(0)))
    room = F.floor((F.coalesce(after - 50, F.col("extent")) - F.col("placed")) * 1000 / F.greatest("length", F.lit(50)))
    return rows.select("rec", "id", low.alias("least"), high.alias("most"), F.when(over > least_over, over).otherwise(0).alias("over"), F.greatest(F.lit(850), F.least(F.lit(1250), room)).cast("long").alias("room_permille"))


def word_gaps(words: DataFrame, none: int = 99_000) -> DataFrame:
    """Words with the silence before their beginning and behind their end, ``none`` at the ends of a recording."""
    order = Window.partitionBy("rec").orderBy("idx")
    return words.withColumns({"before": F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order), F.lit(none)), "after": F.coalesce(F.lead("start_ms").over(order) - F.col("end_ms"), F.lit(none))})


def decibels(energy: Column, n: Column, full: float = 32768.0) -> Column:
    """Level of ``n`` samples of some energy against full scale, -120 where there are none."""
    return F.when(F.coalesce(n, F.lit(0)) == 0, -120.0).otherwise(10 * F.log10(F.greatest(energy / n, F.lit(1e-9)) / (full * full)))


def clip_profile(frames: DataFrame, window: int, ceiling: int, full: float = 32768.0, hole: int = 8) -> DataFrame:
    """(rec, floor_db, speech_db, snr_db, peak, clip_permille, longest_over, zero_permille, holes) of clips (rec, k, v).

    Floor and speech are the levels at 5 and 90 % of whole windows by index; clipping is a run at the ceiling, never one peak; a hole is a run of more than ``hole`` zeros.
    """
    from .frames import index_values

    parts = frames.groupBy("rec", F.floor(F.col("k") / window).alias("win")).agg(F.sum(F.col("v") * F.col("v")).alias("energy"), F.count(F.lit(1)).alias("n")).where(F.col("n") == window)
    levels = index_values(parts, "energy", floor=0.05, speech=0.9)
    kind = F.when(F.abs("v") >= ceiling, 1).when(F.col("v") == 0, 2).otherwise(0)
    runs = frames.withColumn("kind", kind).withColumn("run", F.col("k") - F.row_number().over(Window.partitionBy("rec", "kind").orderBy("k")))
    runs = runs.groupBy("rec", "kind", "run").agg(F.count(F.lit(1)).alias("n"), F.max(F.abs("v")).alias("peak"))
    of = lambda k: F.when(F.col("kind") == k, F.col("n")).otherwise(0)
    sums = runs.groupBy("rec").agg(F.max("peak").alias("peak"), F.sum("n").alias("all"), F.sum(of(1)).alias("over"), F.max(of(1)).alias("longest_over"), F.sum(of(2)).alias("zeros"), F.count_if((F.col("kind") == 2) & (F.col("n") > hole)).alias("holes"))
    floor, speech = (decibels(F.col(c), F.lit(window), full) for c in ("floor", "speech"))
    permille = lambda c: F.floor(1000 * F.col(c) / F.col("all"))
    return levels.join(sums, "rec").select("rec", floor.alias("floor_db"), speech.alias("speech_db"), (speech - floor).alias("snr_db"), "peak", permille("over").alias("clip_permille"), "longest_over", permille("zeros").alias("zero_permille"), "holes")


def take_listing(takes: DataFrame, raw: DataFrame, short: float = 0.9) -> DataFrame:
    """(rec, frames, peak, rms, raw_frames, shortened) of takes (rec, k, v) beside their raw recordings: a take below ``short`` of its raw length is shortened; null where there is no raw one."""
    measured = takes.groupBy("rec").agg(F.count(F.lit(1)).alias("frames"), F.max(F.abs("v")).alias("peak"), F.sqrt(F.sum(F.col("v") * F.col("v")) / F.count(F.lit(1))).alias("rms"))
    whole = raw.groupBy("rec").agg(F.count(F.lit(1)).alias("raw_frames"))
    return measured.join(whole, "rec", "left").withColumn("shortened", F.col("frames") < short * F.col("raw_frames"))


def clip_measures(frames: DataFrame, clicks: DataFrame, words: DataFrame, per_second: int, within: float = 0.0316) -> DataFrame:
    """(rec, seconds, pace, clicks_per_minute, level) of clips (rec, k, v): words (rec, words) a minute, clicks (rec, k) a minute, and the median magnitude of the frames within ``within`` of the loudest."""
    sized = frames.groupBy("rec").agg((F.count(F.lit(1)) / per_second).alias("seconds"), F.max(F.abs("v")).alias("top"))
    loud = frames.join(sized.select("rec", "top"), "rec").where(F.abs("v") >= within * F.col("top"))
    level = loud.groupBy("rec").agg(F.percentile(F.abs("v"), F.lit(0.5)).alias("level"))
    many = clicks.groupBy("rec").agg(F.count(F.lit(1)).alias("many"))
    rows = sized.join(level, "rec").join(many, "rec", "left").join(words, "rec", "left")
    return rows.select("rec", "seconds", (F.coalesce("words", F.lit(0)) * 60 / F.col("seconds")).alias("pace"), (F.coalesce("many", F.lit(0)) * 60 / F.col("seconds")).alias("clicks_per_minute"), "level")
