"""Windows over numbered script lines (rec, ord, id, start, end, locked, dropped, …) and edits of the line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _order() -> WindowSpec:
    return Window.partitionBy("rec").orderBy("ord")


def live_neighbours(lines: DataFrame) -> DataFrame:
    """Lines with prev_live and next_live: ids of the nearest lines that are not dropped."""
    live = F.when(~F.col("dropped"), F.col("id"))
    before = F.last(live, ignorenulls=True).over(_order().rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(live, ignorenulls=True).over(_order().rowsBetween(1, Window.unboundedFollowing))
    return lines.withColumn("prev_live", before).withColumn("next_live", after)


def word_budget(lines: DataFrame, words_per_s: int = 3) -> DataFrame:
    """Lines with ``budget``: words that can be said until the next line starts, or until its own end for the last."""
    until = F.coalesce(F.lead("start").over(_order()), F.col("end"))
    return lines.withColumn("budget", F.floor(F.greatest(until - F.col("start"), F.lit(0)) * words_per_s / 1000))


def overlaps_next(lines: DataFrame, least: int = 60) -> DataFrame:
    """Live lines that reach over the start of the next live one by more than ``least``."""
    rows = lines.where("NOT dropped").withColumn("over", F.col("end") - F.lead("start").over(_order()))
    return rows.where(F.col("over") > least).select("rec", "id", "over")


def reclaimable(lines: DataFrame, least: int = 800) -> DataFrame:
    """Gaps of ``least`` or more behind live lines, up to the next live one."""
    gap = F.lead("start").over(_order()) - F.max("end").over(_order())
    return lines.where("NOT dropped").withColumn("gap", gap).where(F.col("gap") >= least).select("rec", "id", "gap")


def batches(lines: DataFrame, size: int = 40, step: int = 36) -> DataFrame:
    """(rec, batch, ord): overlapping batches of ``size`` lines that begin every ``step``."""
    low = F.greatest(F.lit(0), F.ceil((F.col("ord") - size + 1) / step))
    return lines.select("rec", F.explode(F.sequence(low, F.floor(F.col("ord") / step))).alias("batch"), "ord")


def merge_check(lines: DataFrame, runs: DataFrame) -> DataFrame:
    """Whether each run (rec, run, id) can be merged: two lines or more, adjacent, none dropped, all or none locked."""
    rows = runs.join(lines, ["rec", "id"])
    adjacent = F.max("ord") - F.min("ord") + 1 == F.count(F.lit(1))
    fine = (F.count(F.lit(1)) >= 2) & adjacent & ~F.bool_or("dropped") & (F.bool_or("locked") == F.bool_and("locked"))
    return rows.groupBy("rec", "run").agg(fine.alias("mergeable"))


def merge(lines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The line table with each mergeable run as one line under its first id, and the history (rec, id, part, ord)."""
    fine = merge_check(lines, runs).where("mergeable").select("rec", "run")
    members = runs.join(fine, ["rec", "run"]).join(lines, ["rec", "id"])
    whole = members.groupBy("rec", "run").agg(F.min("ord").alias("ord"), F.min_by("id", "ord").alias("id"), F.min("start").alias("start"), F.max("end").alias("end"), F.bool_and("locked").alias("locked"), F.lit(False).alias("dropped"), F.sum("len").alias("len"), F.max_by("hold", "ord").alias("hold"))
    history = members.join(whole.select("rec", "run", F.col("id").alias("merged")), ["rec", "run"]).select("rec", F.col("merged").alias("id"), F.col("id").alias("part"), "ord")
    rest = lines.join(members.select("rec", "id"), ["rec", "id"], "left_anti")
    return rest.unionByName(whole.select(*rest.columns)), history


def cut(lines: DataFrame, sections: DataFrame) -> DataFrame:
    """Lines with ``dropped`` set where a section (rec, a, b) holds them, and ``straddles`` where one cuts through."""
    from .intervals import overlaps

    met = overlaps(lines.select("rec", "id", F.col("start").alias("a"), F.col("end").alias("b")), sections.withColumn("id", F.monotonically_increasing_id()))
    found = met.groupBy("rec", "id").agg(F.bool_or(F.col("relation") == "inside").alias("inside"), F.bool_or(F.col("relation") == "straddles").alias("straddles"))
    rows = lines.join(found, ["rec", "id"], "left").withColumn("dropped", F.col("dropped") | F.coalesce("inside", F.lit(False)))
    return rows.withColumn("straddles", F.coalesce("straddles", F.lit(False))).drop("inside")


def restore(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Lines whose id is listed (rec, id) are live again."""
    marked = lines.join(ids.select("rec", "id").distinct().withColumn("back", F.lit(True)), ["rec", "id"], "left")
    return marked.withColumn("dropped", F.col("dropped") & F.col("back").isNull()).drop("back")


def slice_at(slices: DataFrame, at: DataFrame, near: int = 350) -> DataFrame:
    """Slices (rec, at) with new instants added, unless one lies within ``near`` already; they meet in buckets of time."""
    width = 2 * near + 1
    reach = F.sequence(F.floor((F.col("at") - near) / width), F.floor((F.col("at") + near) / width))
    x, y = at.withColumn("bucket", F.floor(F.col("at") / width)).alias("x"), slices.select("rec", "at", F.explode(reach).alias("bucket")).alias("y")
    close = (F.col("x.rec") == F.col("y.rec")) & (F.col("x.bucket") == F.col("y.bucket")) & (F.abs(F.col("x.at") - F.col("y.at")) <= near)
    return slices.select("rec", "at").unionByName(x.join(y, close, "left_anti").select("rec", "at")).distinct()


def patch(rows: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the listed columns replaced where the patch map (key, patch) has them; other keys of a patch are ignored."""
    joined = rows.join(patches, key, "left")
    new = {c: F.when(F.map_contains_key("patch", F.lit(c)), F.col("patch")[c].cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(new).select(*rows.columns)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, columns): rows added, removed or changed between two snapshots, with the names of the columns that differ."""
    x, y = old.alias("x"), new.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")), F.lit(c)) for c in columns]))
    change = F.when(F.col(f"x.{key}").isNull(), "added").when(F.col(f"y.{key}").isNull(), "removed").otherwise("changed")
    out = both.select(F.coalesce(f"x.{key}", f"y.{key}").alias(key), change.alias("change"), F.when(change == "changed", F.array_join(differs, ",")).otherwise("").alias("columns"))
    return out.where((F.col("change") != "changed") | (F.col("columns") != ""))


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """A new snapshot of documents (key, rev, state, body): incoming rows replace stored ones with rev = larger + 1.

    A row with a rev above 0 that is stored no more was deleted and stays so. A copy that
    still says ``building`` does not undo a finished state that is newer.
    """
    x, y = stored.alias("x"), incoming.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full_outer")
    both = both.where(F.col(f"x.{key}").isNotNull() | (F.col("y.rev") == 0))
    stale = (F.col("x.rev") > F.col("y.rev")) & (F.col("y.state") == "building") & (F.col("x.state") != "building")
    given = F.col(f"y.{key}").isNotNull()
    return both.select(
        F.coalesce(f"x.{key}", f"y.{key}").alias(key),
        F.when(given, F.greatest(F.coalesce("x.rev", F.lit(0)), "y.rev") + 1).otherwise(F.col("x.rev")).alias("rev"),
        F.when(given & ~F.coalesce(stale, F.lit(False)), F.col("y.state")).otherwise(F.col("x.state")).alias("state"),
        F.when(given, F.col("y.body")).otherwise(F.col("x.body")).alias("body"),
    )


def first_by(rows: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    ranked = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")
