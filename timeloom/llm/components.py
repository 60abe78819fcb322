"""Connected components over a table of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, fewer, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that a link touches; the component is its smallest node.

    Alternates two steps until nothing changes: each node hangs its larger neighbours on its
    smallest one, then its smaller neighbours too. Links only ever get smaller ends, so their
    number does not grow, and a chain shortens by a constant factor in each round. Null ends
    and links from a node to itself are left out; repeated links count once.
    """
    ends = links.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    state, before = written(ends.distinct(), "links"), None
    while True:
        few = fewer(state)
        both = few.unionByName(few.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        hung = both.where(F.col("v") > F.col("u")).join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hung = written(hung, "links")
        few = fewer(hung)
        least = few.groupBy("u").agg(F.min("v").alias("m"))
        small = few.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.v", "e.u")
        last, state = state, written(small.where(F.col("u") != F.col("v")).distinct(), "links")
        discard(last, hung)
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            found = written(state.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), "components")
            discard(state)
            return found
        before = now


#: Nodes in a bucket from which it is first tried against one leader.
LARGE = 64

Side = Callable[[str], Column]


def sides() -> tuple[Side, Side]:
    """Columns of the two rows that a bucket brings together."""
    return (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))


def pair() -> list[Column]:
    left, right = sides()
    return [F.least(left("node"), right("node")).alias("a"), F.greatest(left("node"), right("node")).alias("b")]


def buckets(rows: DataFrame, counted: bool = False) -> DataFrame:
    """Of rows (sig, node, …) those whose bucket holds several nodes, once each; if counted, with its number of rows as many."""
    whole = Window.partitionBy("sig")
    several = rows.withColumn("least", F.min("node").over(whole)).withColumn("most", F.max("node").over(whole)).where("least != most")
    several = several.drop("least", "most").distinct()
    return written(several.withColumn("many", F.count(F.lit(1)).over(whole)) if counted else several, "buckets")


def leader_pairs(shared: DataFrame, near: Column) -> DataFrame:
    """Candidates of large buckets: each node against one leader only, so their number is that of the rows.

    The leader is a bucket's smallest node by a hash of node and bucket, so that nodes which
    meet in several buckets meet several leaders.
    """
    leader = F.min_by(F.struct(*[c for c in shared.columns if c != "sig"]), F.xxhash64("node", "sig")).alias("leader")
    large = shared.groupBy("sig").agg(F.count(F.lit(1)).alias("many"), leader).where(F.col("many") >= LARGE).select("sig", "leader.*")
    left, right = sides()
    return shared.alias("x").join(large.alias("y"), (left("sig") == right("sig")) & (left("node") != right("node")) & near).select(*pair()).distinct()


#: Times that groups are tried against one other group in each bucket before all pairs of a bucket are.
ROUNDS = 1


def _mixed(rows: DataFrame, groups: DataFrame, columns: list[str]) -> DataFrame:
    """The bucket rows with the group of their node, without buckets of one group."""
    rows = rows.select("sig", "node", *columns).join(groups, "node")
    mixed = rows.groupBy("sig").agg((F.min("group") != F.max("group")).alias("mixed")).where("mixed").select("sig")
    return written(rows.join(mixed, "sig", "left_semi"), "open")


def connected(shared: DataFrame, nodes: DataFrame, links: DataFrame, verified: Callable[[DataFrame], DataFrame], near: Column, columns: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(node, group) of ``nodes``: what the links reach that ``verified`` finds among all pairs (a, b) of a bucket.

    ``shared`` has the bucket rows (sig, node and ``columns``), ``near`` is what aliases x and y of two of them must fulfil, and
    ``links`` is known before; it is deleted. Whatever is connected needs no further pair. So in each of ``rounds``
    one node of every group is tried against one of the bucket's first group, another in each
    round, and one pair of two groups at a time; then all pairs of nodes that are still apart.
    """
    left, right = sides()
    found = components(links)
    groups = written(fewer(nodes).join(fewer(found), "node", "left").select("node", F.coalesce("component", "node").alias("group")), "groups")
    discard(found, links)
    rows = shared
    for turn in range(rounds + 1):
        last, rows = rows, _mixed(fewer(rows), fewer(groups), columns)
        if last is not shared:
            discard(last)
        if turn < rounds:
            mine = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", *columns)
            reps = fewer(rows).groupBy("sig", "group").agg(F.min(mine).alias("rep")).select("sig", "group", "rep.*")
            first = reps.groupBy("sig").agg(F.min(F.struct("h", "node", *columns, "group")).alias("rep")).select("sig", "rep.*")
            met = reps.alias("x").join(first.alias("y"), (left("sig") == right("sig")) & (left("group") != right("group")) & near)
            both = F.struct(F.xxhash64(left("node"), right("node"), F.lit(turn)).alias("h"), *pair())
            of = [F.least(left("group"), right("group")).alias("g"), F.greatest(left("group"), right("group")).alias("k")]
            pairs = met.groupBy(*of).agg(F.min(both).alias("p")).select("p.a", "p.b")
        else:
            met = fewer(rows).alias("x").join(fewer(rows).alias("y"), (left("sig") == right("sig")) & (left("node") < right("node")) & (left("group") != right("group")) & near)
            pairs = met.select(*pair()).distinct()
        pairs = written(pairs, "pairs")
        links = verified(pairs)
        ends = [fewer(groups).select(F.col("node").alias(c), F.col("group").alias(f"group_{c}")) for c in "ab"]
        found = components(links.join(ends[0], "a").join(ends[1], "b"), "group_a", "group_b")
        last, groups = groups, written(fewer(groups).join(fewer(found).select(F.col("node").alias("group"), "component"), "group", "left").select("node", F.coalesce("component", "group").alias("group")), "groups")
        discard(last, found, links, pairs)
    discard(rows)
    return groups


def open_pairs(shared: DataFrame, links: DataFrame, near: Column) -> DataFrame:
    """Bucket rows (aliases x and y) of nodes that ``links`` do not connect yet; a bucket of one component is left out.

    Leaders only save work: these pairs cover whatever they miss. ``shared`` is deleted.
    """
    found = components(links)
    group = found.withColumnRenamed("component", "group")
    rows = shared.join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    mixed = rows.groupBy("sig").agg((F.min("group") != F.max("group")).alias("mixed")).where("mixed").select("sig")
    rows, (left, right) = written(rows.join(mixed, "sig", "left_semi"), "open"), sides()
    discard(shared, found)
    return rows.alias("x").join(rows.alias("y"), (left("sig") == right("sig")) & (left("node") < right("node")) & (left("group") != right("group")) & near)
