"""Scores, ranked picks and sequential stopping rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timeloom.functions import text as t

from .stored import settled


def candidate_score(clicks: Column, pace: Column, pace_sd: Column, pitch_sd: Column, level_sd: Column, target: float = 145.0) -> Column:
    """Lower is better; a missing pitch spread counts as 3."""
    return 0.3 * clicks + 0.25 * F.abs(pace - target) + 0.3 * pace_sd + 4 * F.coalesce(pitch_sd, F.lit(3.0)) + 2 * level_sd


def checkpoint_score(wrong: Column, hot: Column, pitch_sd: Column, floor_sd: Column, pace_sd: Column) -> Column:
    """Faults and spreads; a spread that is missing or 0 counts as its default."""
    default = lambda c, d: F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(d))
    return 10 * (wrong + hot) + 0.6 * default(pitch_sd, 20.0) + 0.4 * default(floor_sd, 10.0) + 0.05 * default(pace_sd, 40.0)


def gated(wrong: Column, takes: Column, most: float = 0.2) -> Column:
    return wrong / F.greatest(takes, F.lit(1)) > most


def ranked(rows: DataFrame, group: list[str], gate: str, score: str, tie: str) -> DataFrame:
    """Adds ``place``: gated candidates last, then by score."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(gate, score, tie)))


def best_attempt(takes: DataFrame, keys: list[str], clean: Column, most: int = 3) -> DataFrame:
    """One attempt of each key: the first clean one, else the highest score, else the earlier."""
    rows = takes.where(F.col("attempt") <= most).withColumn("clean", clean)
    best = F.max_by(F.struct("attempt", "id", "clean"), F.struct("clean", F.when(F.col("clean"), -F.col("attempt")).otherwise(F.col("score")), -F.col("attempt")))
    return rows.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.*")


def early_stop(rows: DataFrame, group: list[str], order: str, score: str, patience: int = 3) -> DataFrame:
    """Rows up to the one at which ``patience`` in a row have not beaten the best before them; adds ``stalled``."""
    w = Window.partitionBy(*group).orderBy(order)
    best = F.min(score).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("better", best.isNull() | (F.col(score) < best))
    rows = rows.withColumn("run", F.sum(F.col("better").cast("int")).over(w))
    rows = rows.withColumn("stalled", F.row_number().over(Window.partitionBy(*group, "run").orderBy(order)) - 1)
    stop = F.min(F.when(F.col("stalled") >= patience, F.col(order))).over(Window.partitionBy(*group))
    return rows.withColumn("stop", stop).where(F.col("stop").isNull() | (F.col(order) <= F.col("stop"))).drop("better", "run", "stop")


def capped(rows: DataFrame, group: list[str], within: str, order: list[Column], each: int = 4, overall: int = 14) -> DataFrame:
    """The best rows of each group, at most ``each`` of one ``within`` value and ``overall`` together; adds ``place``."""
    rows = rows.withColumn("own", F.row_number().over(Window.partitionBy(*group, within).orderBy(*order))).where(F.col("own") <= each)
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("place") <= overall)
    return rows.drop("own")


def pick_examples(wanted: DataFrame, bank: DataFrame, stop: list[str], each: int = 4, overall: int = 14) -> DataFrame:
    """(item_id, source, doc_id, score, place): of bank (doc_id, source, text) the best for each wanted line (item_id, text), ``each`` of one source at most.

    The score is the squared overlap of content words for the size of the example. All rows
    are scored; each batch passes on its ``each`` best of an item and source, as no other can
    be among the best. The wanted lines' words are broadcast; repeated items count as one text.
    """
    lines = wanted.select("item_id", F.explode(t.content_words(F.col("text"), stop)).alias("word")).groupBy("word").agg(F.collect_set("item_id").alias("items")).collect()
    ids = sorted({i for r in lines for i in r["items"]})
    number = {x: i for i, x in enumerate(ids)}
    shared = wanted.sparkSession.sparkContext.broadcast({r["word"]: np.array([number[i] for i in r["items"]], np.int64) for r in lines})
    token, schema = re.compile("[A-Za-z0-9']+"), wanted.select("item_id").schema.simpleString()[7:-1] + "," + bank.select("source", "doc_id").schema.simpleString()[7:-1] + ",score:bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items_of = shared.value
        for batch in batches:
            docs, items, scores = [], [], []
            for at, text in enumerate(batch["text"]):
                known = {w.lower() for w in token.findall(text or "") if len(w) > 3}.difference(stop)
                met = [items_of[w] for w in known if w in items_of]
                if met:
                    item, n = np.unique(np.concatenate(met), return_counts=True)
                    docs.append(np.full(len(item), at))
                    items.append(item)
                    scores.append(n * n * 1_000_000 // (len(known) + 1))
            if docs:
                rows = batch[["source", "doc_id"]].iloc[np.concatenate(docs)].reset_index(drop=True)
                rows.insert(0, "item", np.concatenate(items))
                rows["score"] = np.concatenate(scores)
                best = rows.sort_values(["score", "doc_id"], ascending=[False, True]).groupby(["item", "source"], dropna=False, sort=False).head(each)
                best.insert(0, "item_id", [ids[i] for i in best["item"]])
                yield best.drop(columns="item")

    scored = bank.select("source", "doc_id", "text").mapInPandas(run, schema)
    return capped(scored, ["item_id"], "source", [F.desc("score"), F.col("doc_id")], each, overall)


def retrieval_score(known: Column, wanted: Column, said_words: Column, final_words: Column) -> Column:
    """Overlap of content words against the example's size, and how much the example was shortened."""
    return overlap_score(F.size(F.array_intersect(known, wanted)), F.size(known), said_words, final_words)


def overlap_score(shared: Column, size: Column, said_words: Column, final_words: Column) -> Column:
    return shared / (F.sqrt(size) + 1) + 0.4 * F.greatest(F.lit(0.0), 1 - final_words / F.greatest(F.lit(1), said_words))


#: Words of wanted lines (item and word, some 30 bytes) that are broadcast at most; beyond, examples are shuffled to them.
BROADCAST_WORDS = 1_000_000

#: Pairs of a line and an example after which a task drops those that cannot be among the best, and rows that it keeps at most.
MET_PAIRS, KEPT_ROWS = 500_000, 250_000

#: What is known of an example.
FACTS = ("size", "said_words", "final_words")


def _firsts(rows: pa.Table, each: int) -> pa.Table:
    """The ``each`` first rows of an item and source by ``overlap_score``, then doc_id."""
    item, shared, size, said, final = (rows.column(c).to_numpy() for c in ("item", "shared", *FACTS))
    score = shared / (np.sqrt(size) + 1) + 0.4 * np.maximum(0.0, 1 - final / np.maximum(1, said))
    of = rows.column("source").combine_chunks().dictionary_encode("encode").indices.to_numpy()
    by_doc = np.empty(len(rows), np.int64)
    by_doc[pc.array_sort_indices(rows.column("doc_id").combine_chunks(), null_placement="at_start").to_numpy()] = np.arange(len(rows))
    order = np.lexsort((by_doc, -score, of, item))
    item, of, at = item[order], of[order], np.arange(len(order))
    head = np.append(True, (item[1:] != item[:-1]) | (of[1:] != of[:-1]))[: len(at)]
    return rows.take(pa.array(order[at - np.maximum.accumulate(np.where(head, at, 0)) < each]))


def _met_in_tasks(words: DataFrame, bank: DataFrame, stop: list[str], each: int) -> tuple[DataFrame, DataFrame]:
    """Examples that can be among the best: (item_id, doc_id, source, facts, shared) by the words (item_id, word) that they share, and the same without item_id by what they are alone.

    Texts are cut into words once, and a task passes on only the ``each`` first of an item and source.
    """
    numbers: dict = {}
    items: dict[str, list[int]] = {}
    for row in words.toLocalIterator():
        items.setdefault(row["word"], []).append(numbers.setdefault(row["item_id"], len(numbers)))
    given = words.sparkSession.sparkContext.broadcast({w: np.array(n, np.int64) for w, n in items.items()})
    token, none = re.compile("[A-Za-z0-9']+"), np.full(1, -1)
    number = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType([number("item"), bank.schema["doc_id"], bank.schema["source"], *map(number, FACTS), number("shared")])

    def pieces(batch: pa.RecordBatch, items_of: dict[str, np.ndarray]) -> Iterator[pa.Table]:
        """Rows of the schema: each example alone, as item -1, and with each line that it meets."""
        at, facts, item, shared, pairs = [], [], [], [], 0
        for n, (said, final) in enumerate(zip(batch.column("said"), batch.column("final"), strict=True)):
            said, final = token.findall(said.as_py() or ""), token.findall(final.as_py() or "")
            known = {w.lower() for w in {*said, *final} if len(w) > 3}.difference(stop)
            if known:
                met = [items_of[w] for w in known if w in items_of]
                its, many = np.unique(np.concatenate(met), return_counts=True) if met else (none[:0], none[:0])
                at.append(n)
                facts.append((len(known), len(said), len(final)))
                item.append(np.append(none, its))
                shared.append(np.append(0, many))
                pairs += len(its) + 1
            if at and (pairs >= MET_PAIRS or n == batch.num_rows - 1):
                sizes = [len(x) for x in item]
                row = pa.array(np.repeat(at, sizes))
                known_of = np.repeat(np.array(facts, np.int64), sizes, axis=0)
                columns = [pa.array(np.concatenate(item)), batch.column("doc_id").take(row), batch.column("source").take(row), *(pa.array(known_of[:, c]) for c in range(3)), pa.array(np.concatenate(shared))]
                yield pa.table(columns, names=schema.names)
                at, facts, item, shared, pairs = [], [], [], [], 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for rows in pieces(batch, given.value):
                kept = _firsts(rows if kept is None else pa.concat_tables([kept, rows]), each)
                if len(kept) > KEPT_ROWS:
                    yield from kept.to_batches()
                    kept = None
        if kept is not None:
            yield from kept.combine_chunks().to_batches()

    found = settled(bank.select("doc_id", "source", "said", "final").mapInArrow(run, schema))
    named = words.sparkSession.createDataFrame(list(enumerate(numbers)), T.StructType([number("item"), words.schema["item_id"]]))
    return found.join(F.broadcast(named), "item").drop("item"), found.where("item = -1").drop("item")


def _met_by_joins(words: DataFrame, bank: DataFrame, stop: list[str]) -> tuple[DataFrame, DataFrame]:
    """The same for any number of words: examples are shuffled to the lines by word."""
    text = {c: F.coalesce(c, F.lit("")) for c in ("said", "final")}
    counts = {f"{c}_words": F.size(t.script_tokens(x)).cast("long") for c, x in text.items()}
    known = F.array_distinct(F.concat(*[t.content_words(x, stop) for x in text.values()]))
    rows = bank.select("doc_id", "source", F.explode(F.array(F.struct(known.alias("known"), *[n.alias(c) for c, n in counts.items()]))).alias("e")).select("doc_id", "source", "e.*").where(F.size("known") > 0)
    rows = rows.withColumn("size", F.size("known").cast("long"))
    met = rows.select("doc_id", "source", *FACTS, F.explode("known").alias("word")).join(words, "word").groupBy("item_id", "doc_id", "source", *FACTS).agg(F.count(F.lit(1)).alias("shared"))
    return met, rows.select("doc_id", "source", *FACTS, F.lit(0).cast("long").alias("shared"))


def best_examples(wanted: DataFrame, bank: DataFrame, stop: list[str], each: int = 4, overall: int = 14) -> DataFrame:
    """(item_id, source, doc_id, score, place): of bank (doc_id, source, said, final) the best examples for each wanted line (item_id, text), ``each`` of one source at most.

    ``retrieval_score`` counts what an example's content words share with the line's and how much it was shortened. Examples
    meet lines by the words they share, counted within a task. One that shares none counts by its shortening alone: of
    those only the first ``overall`` of all examples by that, ``each`` of one source, can be among a line's best, so they are few.
    Examples without a content word are left out; of equal scores the smaller doc_id comes first; repeated items count as one text.
    """
    words = wanted.select("item_id", F.explode(t.content_words(F.coalesce("text", F.lit("")), stop)).alias("word")).distinct()
    met, alone = _met_in_tasks(words, bank, stop, each) if words.count() <= BROADCAST_WORDS else _met_by_joins(words, bank, stop)
    columns = ["doc_id", "source", *FACTS]
    score = overlap_score(*[F.col(c) for c in ("shared", *FACTS)])
    order = [F.desc("score"), F.col("doc_id")]
    own = alone.withColumn("score", score).withColumn("own", F.row_number().over(Window.partitionBy("source").orderBy(*order))).where(F.col("own") <= each)
    shortest = own.orderBy(*order).limit(overall).select(F.lit(0).alias("one"), *columns, "shared")
    items = wanted.select("item_id").distinct().withColumn("one", F.lit(0))
    unmet = items.join(F.broadcast(shortest), "one").drop("one")
    scored = met.unionByName(unmet).groupBy("item_id", *columns).agg(F.max("shared").alias("shared"))
    return capped(scored.select("item_id", "source", "doc_id", score.alias("score")), ["item_id"], "source", order, each, overall)


def hold_out(groups: DataFrame, key: str, size: str, seed: int = 7, least: int = 12) -> DataFrame:
    """Groups with ``held``: whole groups in hash order until max(least, a twelfth of all rows) is reached.

    Sizes are summed over buckets of the hash first, so no task sees all groups in order.
    """
    rows = groups.withColumn("h", F.pmod(F.crc32(F.encode(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")), "UTF-8")), F.lit(1 << 20)))
    bucket = F.floor(F.col("h") / 1024)
    sums = rows.groupBy(bucket.alias("bucket")).agg(F.sum(size).alias("n"))
    before = sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = rows.agg(F.sum(size).alias("all"))
    inner = F.coalesce(F.sum(size).over(Window.partitionBy("bucket").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("bucket", bucket).join(F.broadcast(before.select("bucket", "before")), "bucket").crossJoin(F.broadcast(total))
    return rows.withColumn("held", F.col("before") + inner < F.greatest(F.lit(least), F.floor(F.col("all") / 12))).drop("bucket", "before", "all", "h")


def greedy_pick(rows: DataFrame, quota: float) -> DataFrame:
    """(pool, id): clips (pool, id, source, number, distance, seconds) by distance, none next to one picked of its source, until the quota is filled.

    Only the first clip of a number can be picked: what keeps it out keeps out all others of that number, too. Of two neighbours the
    first one decides, so each falling step towards the next smaller distance turns the choice: a clip is picked if on both
    sides an even number of falling steps leads to the nearest low. The quota is a running sum over what is left. Without a
    pool, source or number no clip is picked; those without distance come last.
    """
    rank = F.struct(F.col("distance").isNull(), F.col("distance"), F.col("id"))
    clips = rows.where("pool IS NOT NULL AND source IS NOT NULL AND number IS NOT NULL").groupBy("pool", "source", "number").agg(F.min(F.struct(rank.alias("rank"), "seconds")).alias("c"))
    clips = clips.select("pool", "source", "number", "c.rank", F.col("c.rank.id").alias("id"), F.col("c.rank.distance").alias("distance"), "c.seconds")

    def steps(order: Column, gap: int) -> Column:
        """Falling steps from a clip to the low on the side from which ``order`` comes."""
        along = Window.partitionBy("pool", "source").orderBy(order)
        place = F.row_number().over(along)
        falls = F.coalesce((F.lag("number").over(along) == F.col("number") - gap) & (F.lag("rank").over(along) < F.col("rank")), F.lit(False))
        return place - F.last(F.when(~falls, place), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow))

    clips = clips.withColumn("below", steps(F.col("number").asc(), 1)).withColumn("above", steps(F.col("number").desc(), -1))
    kept = clips.where("below % 2 = 0 AND above % 2 = 0").select("pool", "id", "distance", "seconds")
    before = F.sum("seconds").over(Window.partitionBy("pool").orderBy(F.asc_nulls_last("distance"), "id").rowsBetween(Window.unboundedPreceding, -1))
    return kept.withColumn("before", F.coalesce(before, F.lit(0.0))).where(F.col("before") < quota).select("pool", "id")
