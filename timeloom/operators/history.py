"""Tables with a past: versions with validity, pointers that move and move back, merges that can be undone, trash and layered settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lines import merge


def versions(changes: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """(key, version, columns, valid_from, valid_to) of changes (key, at, columns): one row for each time the columns became others than before.

    ``valid_to`` is where the next version begins, null for the current one. Of changes at one time the last by ``order`` counts;
    nulls are values.
    """
    latest = Window.partitionBy(*key, "at").orderBy(*[F.desc(c) for c in order], "at")
    rows = changes.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1")
    along = Window.partitionBy(*key).orderBy("at")
    before = F.lag(F.struct(*columns)).over(along)
    fresh = rows.withColumn("_fresh", before.isNull() | ~F.struct(*columns).eqNullSafe(before)).where("_fresh")
    return fresh.select(*key, F.row_number().over(along).cast("long").alias("version"), *columns, F.col("at").alias("valid_from"), F.lead("at").over(along).alias("valid_to"))


def as_of(history: DataFrame, at: Column) -> DataFrame:
    """The versions that are valid at a time."""
    return history.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def changed(history: DataFrame, news: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The history after news (key, at, columns), one row a key: where they say something new the current version ends at ``at`` and another begins.

    News older than the current version's beginning are left out. A snapshot is rewritten; only current versions meet news.
    """
    current = history.where("valid_to IS NULL")
    said = news.select(*key, F.col("at").alias("_at"), F.struct(*columns).alias("_new"))
    met = said.join(current.select(*key, F.col("version").alias("_version"), F.col("valid_from").alias("_from"), F.struct(*columns).alias("_old")), key, "left")
    moves = met.where(F.col("_version").isNull() | (~F.col("_new").eqNullSafe(F.col("_old")) & (F.col("_at") > F.col("_from"))))
    begun = moves.select(*key, (F.coalesce("_version", F.lit(0)) + 1).alias("version"), *[F.col(f"_new.{c}").alias(c) for c in columns], F.col("_at").alias("valid_from"), F.lit(None).cast(history.schema["valid_to"].dataType).alias("valid_to"))
    ended = history.join(moves.select(*key, "_at"), key, "left")
    ended = ended.withColumn("valid_to", F.when(F.col("valid_to").isNull(), F.col("_at")).otherwise(F.col("valid_to"))).select(*history.columns)
    return ended.unionByName(begun)


def rolled_back(history: DataFrame, wanted: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """The history after each wanted key (key, to, at) got at ``at`` what it was at the time ``to``; keys that were nothing then stay."""
    past = history.join(wanted.select(*key, "to", "at"), key).where((F.col("valid_from") <= F.col("to")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("to"))))
    return changed(history, past.select(*key, "at", *columns), key, columns)


def adopted(pointers: DataFrame, wishes: DataFrame, profiles: DataFrame, key: list[str]) -> DataFrame:
    """News (key, at, name, score) for wishes (key, name, at): only names that the profiles (key, name, score) have; the best of several scores counts."""
    known = profiles.groupBy(*key, "name").agg(F.max("score").alias("score"))
    return wishes.join(known, [*key, "name"]).join(pointers.select(*key).distinct(), key, "left_semi").select(*key, "at", "name", "score")


def merged(lines: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with mergeable runs as one line each, and the archive (rec, into, original): the lines that went into them, whole."""
    done, history = merge(lines, runs)
    parts = history.select("rec", F.col("id").alias("into"), F.col("part").alias("id"))
    whole = F.struct(*[F.col(f"`{c}`") for c in lines.columns]).alias("original")
    return done, lines.withColumn("original", whole).join(parts, ["rec", "id"]).select("rec", "into", "original")


def unmerged(lines: DataFrame, archive: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines and archive after the merges of some ids (rec, id) were undone: the lines that went into them are back as they were. Ids that are no merge stay."""
    undone = archive.join(ids.select("rec", F.col("id").alias("into")).distinct(), ["rec", "into"])
    rest = lines.join(undone.select("rec", F.col("into").alias("id")).distinct(), ["rec", "id"], "left_anti")
    return rest.unionByName(undone.select("original.*")), archive.join(ids.select("rec", F.col("id").alias("into")), ["rec", "into"], "left_anti")


def trashed(documents: DataFrame, ids: DataFrame, at: Column, key: str = "id") -> DataFrame:
    """Documents with ``deleted_at`` set for the listed ids that are not in the trash yet; nothing is lost."""
    listed = ids.select(key).distinct().withColumn("_gone", F.lit(True))
    return documents.join(listed, key, "left").withColumn("deleted_at", F.when(F.col("deleted_at").isNull() & F.col("_gone"), at).otherwise(F.col("deleted_at"))).select(*documents.columns)


def layered(*layers: Column, kind: T.DataType) -> Column:
    """One value of layers, the first on top: of structs each field by itself, at any depth; else the first value that is not null. An array counts as one value."""
    if not isinstance(kind, T.StructType):
        return F.coalesce(*layers)
    return F.struct(*[layered(*[x.getField(f.name) for x in layers], kind=f.dataType).alias(f.name) for f in kind.fields])


def tidy(terms: Column) -> Column:
    """Terms without blanks around them, empty ones or ones that are there already, whatever their case: the first spelling stays."""
    clean = F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(clean, lambda x, i: F.array_position(F.transform(clean, F.lower), F.lower(x)) == i + 1)


def tidy_aliases(aliases: Column) -> Column:
    """A map of spellings with trimmed lower-case keys and trimmed values; pairs with an empty side go, of one key the first stays."""
    pairs = F.filter(F.transform(F.map_entries(aliases), lambda e: F.struct(F.lower(F.trim(e["key"])).alias("key"), F.trim(e["value"]).alias("value"))), lambda e: (e["key"] != "") & (e["value"] != ""))
    return F.map_from_entries(F.filter(pairs, lambda e, i: F.array_position(F.transform(pairs, lambda x: x["key"]), e["key"]) == i + 1))


def masked(masks: DataFrame, added: DataFrame, patches: DataFrame, removed: DataFrame) -> DataFrame:
    """Masks (rec, id, from, to) after additions (rec, from, to), patches (rec, id, from, to; null keeps) and removals (rec, id), numbered ``place`` by beginning.

    New masks get the ids behind the largest, by beginning; an end before its beginning is the beginning.
    """
    next_id = masks.groupBy("rec").agg(F.max("id").alias("last"))
    fresh = added.join(next_id, "rec", "left").withColumn("id", F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("rec").orderBy("from", "to"))).select("rec", "id", "from", "to")
    kept = masks.join(removed.select("rec", "id").distinct(), ["rec", "id"], "left_anti").alias("m").join(patches.alias("p"), (F.col("m.rec") == F.col("p.rec")) & (F.col("m.id") == F.col("p.id")), "left")
    kept = kept.select("m.rec", "m.id", F.coalesce("p.from", "m.from").alias("from"), F.coalesce("p.to", "m.to").alias("to"))
    rows = kept.unionByName(fresh).withColumn("to", F.greatest("from", "to"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("rec").orderBy("from", "id")).cast("long"))


def flowed(lines: DataFrame, results: DataFrame) -> DataFrame:
    """Lines (rec, id, say, machine, locked) with results (rec, id, text) written where the line is neither locked nor edited by hand and the text differs: say, machine, previous and written.

    A line is edited by hand if it is not what the machine last wrote there. What was there is remembered as ``previous``.
    """
    rows = lines.join(results.select("rec", "id", F.col("text").alias("_text")), ["rec", "id"], "left")
    write = F.col("_text").isNotNull() & ~F.col("locked") & (F.trim("_text") != "") & F.coalesce(F.col("say") == F.col("machine"), F.lit(False)) & (F.col("_text") != F.col("say"))
    return rows.select(*[c for c in lines.columns if c not in ("say", "machine")], F.when(write, F.col("_text")).otherwise(F.col("say")).alias("say"), F.when(write, F.col("_text")).otherwise(F.col("machine")).alias("machine"), F.when(write, F.col("say")).alias("previous"), write.alias("written"))


def statuses(stored: Column, ids: Column, status: Column) -> Column:
    """A map of ids to states with ``status`` for the given ids."""
    given = F.map_from_arrays(ids, F.transform(ids, lambda _: status))
    return F.map_concat(F.map_filter(stored, lambda k, _: ~F.array_contains(ids, k)), given)


def with_room(placed: DataFrame, lines: DataFrame, captions: DataFrame, least: int = 10) -> DataFrame:
    """Placed spans (rec, id, a, b) that end later by the ``hold`` their line (rec, id, hold, held) was given, if that is above ``least``; with ``held`` and the caption (rec, id, caption), null where there is none."""
    given = lines.select("rec", "id", F.coalesce("hold", F.lit(0)).alias("_hold"), F.coalesce("held", F.lit(False)).alias("held"))
    rows = placed.join(given, ["rec", "id"], "left").join(captions, ["rec", "id"], "left")
    return rows.select("rec", "id", "a", (F.col("b") + F.when(F.col("_hold") > least, F.col("_hold")).otherwise(0)).alias("b"), F.coalesce("held", F.lit(False)).alias("held"), "caption")
