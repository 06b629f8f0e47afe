"""Mixing overlapping sources to target weights by a min-cost flow.

A document has a size in words and belongs to one source or to several. Sources share a number
of words by weight; a source's share stops at ``most`` times its size, and the excess is shared
anew by weight among the others until none is above. Each source's target is a quota.

Documents are aggregated by membership pattern (the set of their sources). Words flow from
patterns to sources: a pattern gives its words once at no cost, a second time at cost one, a
third time at cost two and so on up to ``most`` times (convex costs), to any source of the
pattern, until the quotas are met or no word is left. A path that reroutes words changes the
repetition of its first pattern only, so its cost is the next repetition's: a flow of least cost
comes from opening one repetition of all patterns after the other, and augmenting to a maximum
flow in between. Patterns of sources that share no document are settled on Spark, each for
itself; the others (aggregates, at most MOST_PATTERNS of them, else the job fails) by the flow
on the driver.

A pattern's words are taken in whole documents: each of them as often as all can be taken, and
once more those that a seeded hash selects. Selection is by size class (powers of two), so that
long and short documents are chosen alike: in each class documents in hash order while they fit
the class's share; what is then missing is filled with left-over documents from the smallest
class on, the last one if that comes nearer. Running totals over a range-partitioned order
replace any sort of a source in one task. Every step is a function of ids, sizes, sources and
seed, so reruns agree.

A null text has size zero; a document of size zero or without a source takes nothing. A null
source is a source of its own, the last in order. Repeated rows count each, and repeated ids
share their place in the hash order. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import quoted
from ..functions.ranking import order_keys, ranked_dictionary, running_totals
from ..session import cut_lineage, local_table
from .common import joined_by_share, text_of

#: Patterns of overlapping sources that the flow takes to the driver.
MOST_PATTERNS = 100_000
#: A source's name is marked, so that the null source has a name too and is the last.
NAMED, NULL = "a", "b"


def word_count(text_column: str) -> Column:
    """Runs of anything but white space."""
    return F.regexp_count(text_of(text_column), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def pattern_of(docs: DataFrame, source_column: str) -> Column:
    """The sorted marked names of a document's sources, from a column of names or of lists of names."""
    source = quoted(source_column)
    if isinstance(docs.schema[source_column].dataType, T.ArrayType):
        names = F.coalesce(source, F.array(F.lit(None)))
    else:
        names = F.array(source)
    marked = F.transform(names, lambda s: F.coalesce(F.concat(F.lit(NAMED), s.cast("string")), F.lit(NULL)))
    return F.array_sort(F.array_distinct(marked))


def source_targets(patterns: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(name, source_size, target) of every source, from (pattern, size) rows.

    ``weights`` repeat over the sources in code-point order of their names; the targets add up
    to ``share`` of all words, unless all sources stop at ``most`` times their size.
    """
    total = patterns.agg(F.sum("size")).first()[0] or 0
    members = patterns.select(F.explode("pattern").alias("name"), "size")
    sizes = cut_lineage(members.groupBy("name").agg(F.sum("size").alias("source_size")))
    ranks = ranked_dictionary(sizes, "name").select(F.col("value").alias("name"), "code")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sources = cut_lineage(
        sizes.join(ranks, "name").select(
            "name", "source_size", cycle[(F.col("code") % len(weights)).cast("int")].alias("weight")
        )
    )
    cap = F.col("source_size") * float(most)
    level, stopped = 0.0, -1
    while True:
        above = F.col("weight") * level > cap
        row = sources.agg(
            F.sum(F.when(above, cap)).alias("held"),
            F.sum(F.when(~above, F.col("weight"))).alias("open"),
            F.count(F.when(above, 1)).alias("stopped"),
        ).first()
        if row.stopped == stopped or not row.open:
            break
        stopped = row.stopped
        level = max(0.0, total * share - (row.held or 0.0)) / row.open
    target = F.least(F.col("weight") * level, cap) if row.open else cap
    return cut_lineage(sources.select("name", "source_size", target.alias("target")))


def route(capacity: list[int], members: list[list[int]], quotas: list[int], most: int) -> list[list[int]]:
    """Words that flow from each pattern to each of its sources, at least cost of repetitions.

    Dinic's maximum flow, once per repetition level; earlier flow stays and may be rerouted.
    """
    patterns, end = len(capacity), len(capacity) + len(quotas) + 1
    heads: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, size: int) -> int:
        for u, v, r in ((a, b, size), (b, a, 0)):
            heads[u].append(len(to))
            to.append(v)
            room.append(r)
        return len(to) - 2

    start = patterns + len(quotas)
    supply = [arc(start, p, 0) for p in range(patterns)]
    flows = [[arc(p, patterns + s, most * capacity[p]) for s in members[p]] for p in range(patterns)]
    for s, quota in enumerate(quotas):
        arc(patterns + s, end, quota)
    for _ in range(most):
        for p in range(patterns):
            room[supply[p]] += capacity[p]
        while True:
            depth = {start: 0}
            queue = deque([start])
            while queue and end not in depth:
                u = queue.popleft()
                for a in heads[u]:
                    if room[a] and to[a] not in depth:
                        depth[to[a]] = depth[u] + 1
                        queue.append(to[a])
            if end not in depth:
                break
            at = [0] * len(heads)
            path: list[int] = []
            u = start
            while True:
                if u == end:
                    size = min(room[a] for a in path)
                    for a in path:
                        room[a] -= size
                        room[a ^ 1] += size
                    path, u = [], start
                    continue
                while at[u] < len(heads[u]):
                    a = heads[u][at[u]]
                    if room[a] and depth.get(to[a]) == depth[u] + 1:
                        break
                    at[u] += 1
                if at[u] < len(heads[u]):
                    path.append(a)
                    u = to[a]
                elif u == start:
                    break
                else:
                    u = to[path.pop() ^ 1]
                    at[u] += 1
    return [[room[a ^ 1] for a in arcs] for arcs in flows]


def pattern_flows(patterns: DataFrame, sources: DataFrame, most: int) -> DataFrame:
    """(pattern, size, flow): the words that the mix takes of every pattern of (pattern, size) rows."""
    quota = F.floor(F.col("target") + 0.5).cast("bigint")
    quotas = sources.select("name", quota.alias("quota"))
    mixed = patterns.where(F.size("pattern") > 1)
    shared = cut_lineage(mixed.select(F.explode("pattern").alias("name")).distinct())
    alone = patterns.where(F.size("pattern") == 1).withColumn("name", F.col("pattern")[0])
    single = alone.join(shared, "name", "left_anti").join(quotas, "name")
    settled = single.select("pattern", "size", F.least("quota", F.col("size") * most).alias("flow"))
    joint = mixed.unionByName(alone.join(shared, "name", "left_semi").select("pattern", "size"))
    rows = joint.orderBy("pattern").limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"over {MOST_PATTERNS} patterns of overlapping sources")
    wanted = sorted((r.name, r.quota) for r in quotas.join(shared, "name").collect())
    spot = {name: i for i, (name, _) in enumerate(wanted)}
    found = route([r.size for r in rows], [[spot[n] for n in r.pattern] for r in rows], [q for _, q in wanted], most)
    routed = [(r.pattern, r.size, sum(f)) for r, f in zip(rows, found)]
    return settled.unionByName(local_table(patterns.sparkSession, routed, "pattern array<string>, size bigint, flow bigint"))


def mix_sources(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    source_column: str,
    weights: list[float],
    share: float = 1.5,
    most: int = 2,
    seed: int = 13,
) -> tuple[DataFrame, DataFrame]:
    """The mix: id, pattern, size and taken of every row; and name, source_size, target of every source.

    ``taken`` is the document's size times how often the mix takes it.
    """
    key, _ = order_keys(["id"], seed, portable=True)
    slim = docs.select(
        quoted(id_column).alias("id"), word_count(text_column).alias("size"), pattern_of(docs, source_column).alias("pattern")
    )
    rows = cut_lineage(
        slim.withColumns({"class": F.floor(F.log2(F.col("size") + 0.5)).cast("int"), "key": key})
    )
    used = rows.where("size > 0 AND size(pattern) > 0")
    patterns = cut_lineage(rows.groupBy("pattern").agg(F.sum("size").alias("size")))
    sources = source_targets(patterns, weights, share, most)
    flows = cut_lineage(
        pattern_flows(patterns.where("size > 0 AND size(pattern) > 0"), sources, most)
        .withColumn("times", F.expr("flow DIV size"))
        .withColumn("extra", F.col("flow") - F.col("times") * F.col("size"))
        .withColumnRenamed("size", "whole")
    )

    ordered = running_totals(used, [F.col(c).asc() for c in ("pattern", "class", "key", "id", "size")], {"upto": F.col("size")})
    ordered = cut_lineage(ordered)
    classes = ordered.groupBy("pattern", "class").agg(
        F.sum("size").alias("words"), F.min(F.col("upto") - F.col("size")).alias("base"), F.count(F.lit(1)).alias("n")
    )
    part = F.floor(F.col("extra") * F.col("words").cast("double") / F.col("whole")).cast("bigint")
    quotas = cut_lineage(classes.join(flows, "pattern").withColumn("part", part))
    placed = cut_lineage(joined_by_share(ordered, quotas, ["pattern", "class"]).withColumn("inside", F.col("upto") - F.col("base")))

    first = F.col("inside") <= F.col("part")
    fitted = placed.groupBy("pattern", "class").agg(
        F.max(F.when(first, F.col("inside"))).alias("fitted"), F.first("words").alias("words"), F.first("extra").alias("extra"), F.count(F.lit(1)).alias("n")
    ).fillna({"fitted": 0})
    # Words left over in smaller classes, and what the classes together leave missing.
    lists = fitted.groupBy("pattern").agg(
        F.array_sort(F.collect_list(F.struct("class", "fitted", (F.col("words") - F.col("fitted")).alias("left"), "n"))).alias("all"),
        F.first("extra").alias("extra"),
    )
    missing = F.col("extra") - F.aggregate("all", F.lit(0).cast("bigint"), lambda s, c: s + c["fitted"])
    spread = lists.withColumn("missing", missing).select("pattern", "missing", "all", F.explode("all").alias("own"))
    before = F.aggregate(
        F.filter("all", lambda c: c["class"] < F.col("own")["class"]), F.lit(0).cast("bigint"), lambda s, c: s + c["left"]
    )
    fills = spread.select("pattern", F.col("own")["class"].alias("class"), "missing", F.col("own")["fitted"].alias("fitted"), before.alias("before"), F.col("own")["n"].alias("n"))
    full = joined_by_share(placed, fills, ["pattern", "class"])
    beyond = F.col("inside") - F.col("fitted") + F.col("before")
    nearer = 2 * beyond - F.col("size") <= 2 * F.col("missing")
    chosen = (F.col("inside") <= F.col("fitted")) | nearer & (F.col("missing") > 0)
    taken = F.col("size") * (F.col("times") + F.when(chosen & (F.col("extra") > 0), 1).otherwise(0))
    mixed = full.select("id", "pattern", "size", taken.cast("bigint").alias("taken"))
    idle = rows.where("NOT (size > 0 AND size(pattern) > 0)").select("id", "pattern", "size", F.lit(0).cast("bigint").alias("taken"))
    return mixed.unionByName(idle), sources


def with_targets(mixed: DataFrame, sources: DataFrame) -> DataFrame:
    """id, size, source_size, target and taken of rows with one source each."""
    counts = mixed.groupBy(F.col("pattern")[0].alias("name")).agg(F.count(F.lit(1)).alias("n"))
    rows = cut_lineage(mixed.withColumn("name", F.col("pattern")[0]))
    return joined_by_share(rows, sources.join(counts, "name"), ["name"]).select("id", "size", "source_size", "target", "taken")
