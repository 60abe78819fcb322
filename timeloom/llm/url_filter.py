"""URL filters: rules by host and path, and a tree of path templates per host judged by labelled purity."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, own_name, written


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Name of the longest rule (host and path together) that fits; of equally long ones the first by name."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (-len(r.name), r.name), reverse=True):
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, rule.name).otherwise(found)
    return found


def _kind(segment: Column) -> Column:
    """Segments that vary by their nature: numbers, numbers with an ending, and hexadecimal keys."""
    return (
        F.when(segment.rlike(r"^\d+$"), "{n}")
        .when(segment.rlike(r"^\d+\.[A-Za-z0-9]{1,5}$"), F.regexp_replace(segment, r"^\d+", "{n}"))
        .when(segment.rlike(r"^(?=.*\d)[0-9a-fA-F]{4,}(-?[0-9a-fA-F]{4,})+$"), "{x}")
        .otherwise(segment)
    )


def _segments(path: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(path, "^/", ""), "/"), _kind)


def _differs(hits: Column, total: Column, all_hits: Column, all_total: Column, z: float) -> Column:
    """Two-proportion test of a branch against its siblings; evidence on one side only counts as a difference."""
    rest_hits, rest = all_hits - hits, all_total - total
    pooled = all_hits / F.greatest(all_total, F.lit(1))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(total, F.lit(1)) + 1 / F.greatest(rest, F.lit(1))))
    gap = F.abs(hits / F.greatest(total, F.lit(1)) - rest_hits / F.greatest(rest, F.lit(1)))
    return F.when((total == 0) & (rest == 0), False).when((total == 0) | (rest == 0), True).otherwise(gap > z * error)


def template_tree(urls: DataFrame, kinds: int = 10, share: float = 0.05, z: float = 1.96) -> DataFrame:
    """Templates of ``urls`` (host, segments, n, labelled, rejected): adds ``template`` and ``shared``.

    Level by level, below each branch: a segment becomes ``*`` if its parent has more than
    ``kinds`` different ones and it has less than ``share`` of its parent's urls. Of the named
    branches left, those whose rejected share, share of ends and share of numbers next do not
    differ from their siblings' (two-proportion tests at ``z``) are merged into ``+``. What a single row (host, segments)
    has below a branch that is its own has no siblings: it stays as it is, and is one step for ``purities``, behind the ``shared`` ones.
    So levels go on as deep as urls of a host share their branches, however many those are.
    """
    columns = [*urls.columns, "template", "shared"]
    nothing = F.lit(None).cast("int")
    state, done = written(urls.withColumn("template", F.lit("")).withColumn("shared", nothing), "template"), []
    sums = ["n", "labelled", "rejected", "ends", "numbered"]
    level = 0
    while not state.isEmpty():
        level += 1
        step = state.withColumn("segment", F.get("segments", F.lit(level - 1)))
        following = F.get("segments", F.lit(level))
        branch = step.where(F.col("segment").isNotNull()).groupBy("host", "template", "segment").agg(
            *[F.sum(c).alias(c) for c in sums[:3]],
            F.sum(F.when(following.isNull(), F.col("n")).otherwise(0)).alias("ends"),
            F.sum(F.when(F.startswith(following, F.lit("{n}")), F.col("n")).otherwise(0)).alias("numbered"),
            F.count(F.lit(1)).alias("rows"),
        )
        parent = branch.groupBy("host", "template").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("all"), F.sum("rows").alias("all_rows"))
        fixed = F.col("segment").startswith("{") | (F.col("segment") == "")
        branch = branch.join(parent, ["host", "template"]).withColumn("name", F.when(~fixed & (F.col("many") > kinds) & (F.col("n") < share * F.col("all")), "*").otherwise(F.col("segment")))
        named = branch.where(~fixed & (F.col("name") != "*")).groupBy("host", "template").agg(F.count(F.lit(1)).alias("named"), *[F.sum(c).alias(f"all_{c}") for c in sums])
        apart = (
            _differs(F.col("rejected"), F.col("labelled"), F.col("all_rejected"), F.col("all_labelled"), z)
            | _differs(F.col("ends"), F.col("n"), F.col("all_ends"), F.col("all_n"), z)
            | _differs(F.col("numbered"), F.col("n"), F.col("all_numbered"), F.col("all_n"), z)
        )
        name = F.when(fixed | (F.col("name") == "*") | (F.coalesce("named", F.lit(0)) < 2) | apart, F.col("name")).otherwise("+")
        branch = branch.join(named, ["host", "template"], "left").select("host", "template", "segment", name.alias("name"), (F.col("all_rows") == 1).alias("alone"))
        tail = F.array_join(F.slice("segments", level, F.greatest(F.size("segments") - level + 1, F.lit(0))), "/")
        further = F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), F.when(F.col("alone"), tail).otherwise(F.col("name"))))
        over = F.col("name").isNull() | F.col("alone") | (F.size("segments") <= level)
        last, moved = state, written(step.join(branch, ["host", "template", "segment"], "left").withColumn("over", over).withColumn("template", further).withColumn("shared", F.when(F.col("alone"), F.lit(level))).select(*columns, "over"), "template")
        done.append(moved.where("over"))
        state = moved.where("NOT over").select(*columns)
        if level == 1:
            discard(last)
    return reduce(DataFrame.unionByName, [d.select(*columns) for d in done], state.select(*columns))


def purities(tree: DataFrame, prior: tuple[float, float], strength: float) -> DataFrame:
    """(host, template, purity): the smoothed share of rejected urls of every template.

    A template with little evidence of its own leans on what is known of wider groups. From the prior on, each of
    these takes the purity of the one before it with the weight of ``strength`` urls: the same
    template over all hosts of the suffix, over the registered domain (the last two labels), then the branches of
    the host from its root down to the template itself.
    """
    totals = [F.sum("labelled").alias("labelled"), F.sum("rejected").alias("rejected")]
    shared = F.max("shared" if "shared" in tree.columns else F.lit(None).cast("int")).alias("shared")
    sums = written(tree.groupBy("host", "template").agg(*totals, shared), "templates")
    parts = F.split("template", "/")
    branches = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.coalesce("shared", F.size(parts)))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    branches = F.when(F.col("shared") < F.size(parts), F.concat(branches, F.array("template"))).otherwise(branches)
    held = sums.select("host", "template", "labelled", "rejected", F.posexplode(branches).alias("depth", "branch"))
    known = held.groupBy("host", "branch").agg(*totals)
    step = F.struct("depth", F.col("known.labelled").alias("labelled"), F.col("known.rejected").alias("rejected"))
    chain = held.drop("labelled", "rejected").join(known.alias("known"), ["host", "branch"]).groupBy("host", "template").agg(F.array_sort(F.collect_list(step)).alias("chain"))
    labels = F.split("host", "\\.")
    chain = chain.withColumn("suffix", F.element_at(labels, -1)).withColumn("domain", F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    lean = lambda known, rejected, labelled: (F.coalesce(rejected, F.lit(0)) + strength * known) / (F.coalesce(labelled, F.lit(0)) + strength)
    purity = F.lit(prior[0] / sum(prior))
    named = chain.select("host", "template", "suffix", "domain")
    for group in ("suffix", "domain"):
        wide = sums.join(named, ["host", "template"]).groupBy(group, "template").agg(F.sum("labelled").alias(f"{group}_labelled"), F.sum("rejected").alias(f"{group}_rejected"))
        chain = chain.join(wide, [group, "template"])
        purity = lean(purity, F.col(f"{group}_rejected"), F.col(f"{group}_labelled"))
    purity = F.aggregate("chain", purity.cast("double"), lambda known, b: lean(known, b["rejected"], b["labelled"]))
    return chain.select("host", "template", purity.alias("purity"))


def judge(pages: DataFrame, rules: list[Rule], keep: list[str], url: str = "url", rejected: Column | None = None, prior: tuple[float, float] = (1.0, 3.0), strength: float = 4.0, least: float = 0.8) -> DataFrame:
    """One row per page: ``keep`` columns, host, path, rule, template, purity and verdict (allow or block), each with underscores behind it where ``keep`` has such a name.

    A rule's verdict holds where one fits. Every page is labelled by its rule, or else by
    ``rejected`` (a nullable boolean column). Any other page is blocked if the purity of its
    template (``purities``) reaches ``least``.
    A null url and one without ``://`` have an empty host and path and count as one template.
    Repeated rows count and are returned as often as they stand there.
    """
    host, path = split_url(F.col(f"`{url}`"))
    names = {c: own_name(pages.select(*[f"`{k}`" for k in keep]), c) for c in ("host", "path", "rule", "template", "purity", "verdict")}
    rows = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept"), host.alias("host"), path.alias("path"), (F.lit(None).cast("boolean") if rejected is None else rejected).alias("own"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules)).withColumn("segments", _segments(F.col("path")))
    verdicts = F.lit(None).cast("string")
    for rule in rules:
        verdicts = F.when(F.col("rule") == rule.name, rule.verdict).otherwise(verdicts)
    rows = rows.withColumn("ruled", verdicts)
    label = F.coalesce(F.col("ruled") == "block", F.col("own"))
    urls = rows.groupBy("host", "segments").agg(F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.count(F.when(label, 1)).alias("rejected"))
    tree = template_tree(urls)
    pure = purities(tree, prior, strength)
    known = written(tree.join(pure, ["host", "template"]).select("host", "segments", "template", "purity"), "purity")
    out = rows.join(known, ["host", "segments"], "left")
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= least, "block").otherwise("allow"))
    found = out.select("kept", "host", "path", "rule", "template", "purity", verdict.alias("verdict"))
    return found.select("kept.*", *[F.col(c).alias(name) for c, name in names.items()])
