"""Totals over any spans of days from a dyadic tree of partial totals per entity.

Level k of the tree cuts the calendar into nodes of 2^k days; a node holds the totals of an
entity's facts in it. A span is the union of at most two nodes per level, so it adds up
O(log days) rows whatever its length, and a fact day is in one node per level.

Above a day's node there are often only larger nodes with the same facts. Such a chain is one
row. It lies in a subtree: that of a block of 2^8 days, or above the blocks that of a node of
the top level. With d fact days in b blocks an entity has less than 2 d + b rows, where each
level has up to d nodes. A span meets the two subtrees of the blocks that it cuts and the one
above them, so it is three rows of a join on (entity, subtree), which spreads an entity with
very many facts or spans over its blocks.

All that a node holds can be merged (counts, sums, the newest day's group), so a tree may be
stored, and a batch of facts is added by merging its own tree into it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.intervals import FactSpec, daily_totals

# Nodes of 2^15 days, some 90 years; longer spans take more nodes of that size.
TOP_LEVEL = 15
# Levels below this one lie in the subtrees of its nodes.
BLOCK_LEVEL = 8
# The root of a subtree as one number, its level in the low bits; rows of spans and of the tree meet in it.
SUBTREE = "level_node"
_LEVEL_BITS = 6


def _node(day: Column, level: Column | int) -> Column:
    return F.call_function("shiftright", day, level if isinstance(level, Column) else F.lit(level))


def _begin(node: Column, level: Column) -> Column:
    return F.call_function("shiftleft", node, level)


def _storeys(top: int) -> list[tuple[int, int, int]]:
    """First and last level in the subtrees of a storey and the level of their roots, from the days up."""
    return [(0, top, top)] if top <= BLOCK_LEVEL else [(0, BLOCK_LEVEL - 1, BLOCK_LEVEL), (BLOCK_LEVEL, top, top)]


def _level_node(node: Column, level: int) -> Column:
    return node * F.lit(1 << _LEVEL_BITS) + F.lit(level)


def _number(day: Column | str) -> Column:
    return F.unix_date(day).cast("bigint")


def _subtree(day: str, root: int) -> Column:
    return _level_node(_node(_number(day), root), root)


def _dealt(rows: DataFrame, parts: int | None, *by: str) -> DataFrame:
    return rows.repartition(parts, *by) if parts else rows


def calendar_tree(facts: DataFrame, spec: FactSpec, top: int = TOP_LEVEL, parts: int | None = None) -> DataFrame:
    """Chains of nodes with facts: key, level_node, low, at, upto, facts, newest (day, group) and each measure.

    ``level_node`` is the subtree; a chain begins with node ``at`` of level ``low`` and ends on
    level ``upto``. Facts without a date or entity are in no span and left out. Days are summed
    first, so an entity brings one row per calendar day, and a block one to the levels above.
    ``parts`` deals facts and blocks into that many by entity and subtree; facts are then
    shuffled once, and what comes out lies as a table in as many buckets.
    """
    key, measures = spec.key, list(spec.measures)
    (first, last, root), *above = _storeys(top)
    dated = facts.filter(F.col(spec.date).isNotNull() & F.col(key).isNotNull())
    dated = dated.withColumn(SUBTREE, _subtree(spec.date, root))
    days = daily_totals(_dealt(dated, parts, key, SUBTREE), spec, SUBTREE)
    tree = _chains(days, key, measures, first, last)
    for first, last, root in above:
        blocks = _summed(days.groupBy(key, SUBTREE), measures).select("*", "newest.*").drop("newest")
        blocks = _dealt(blocks.withColumn(SUBTREE, _subtree("day", root)), parts, key, SUBTREE)
        tree = tree.unionByName(_chains(blocks, key, measures, first, last))
    return tree


def _summed(groups, measures: Sequence[str], *more: Column) -> DataFrame:
    """Rows of different days added up: the newest group needs no order among groups, so sums are hashed, not sorted."""
    sums = groups.agg(
        F.sum("facts").alias("facts"), F.max("day").alias("_day"), F.max_by("group", "day").alias("_group"),
        *[F.sum(c).alias(c) for c in measures], *more,
    )
    return sums.withColumn("newest", F.struct(F.col("_day").alias("day"), F.col("_group").alias("group"))).drop("_day", "_group")


def _chains(rows: DataFrame, key: str, measures: Sequence[str], first: int, last: int) -> DataFrame:
    """The chains of levels first to last over rows of a node of level first each, known by one of its days.

    Two neighbours in a subtree meet on the level of the lowest node that both are in; a node of
    a higher level than the first begins a chain if two neighbours meet in it, and ends below the
    next level on which one of its rows meets a neighbour.
    """
    rows = rows.withColumn("_at", _node(_number("day"), first))
    in_order, at, levels = Window.partitionBy(key, SUBTREE).orderBy("_at"), F.col("_at"), last - first
    meet = {"_left": F.lag(at).over(in_order), "_right": F.lead(at).over(in_order)}
    rows = rows.withColumns(meet).withColumns({c: _meeting(F.col(c), at, levels) for c in meet})
    low = F.least("_left", "_right")
    ups = F.when(low <= levels, F.concat(F.array(F.lit(0)), F.sequence(low, F.lit(levels)))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("_up", F.explode(ups))
    higher = [F.when(F.col(c) > F.col("_up"), F.col(c)) for c in meet]
    nodes = _summed(
        rows.groupBy(key, SUBTREE, "_up", _node(at, F.col("_up")).alias("at")),
        measures,
        F.bool_or(F.col("_left") == F.col("_up")).alias("_meet"),
        F.min(F.least(*higher)).alias("_next"),
    ).filter((F.col("_up") == 0) | F.col("_meet"))
    low, upto = (F.col("_up") + first).alias("low"), (F.col("_next") + (first - 1)).alias("upto")
    return nodes.select(key, SUBTREE, low, "at", upto, "facts", "newest", *measures)


def _meeting(a: Column, b: Column, levels: int) -> Column:
    """How many levels up two nodes of a subtree meet; levels + 1 if that is its root or above, or one is null."""
    bits = F.floor(F.log2(a.bitwiseXOR(b) + F.lit(0.5))) + 1
    return F.least(F.coalesce(bits.cast("int"), F.lit(levels + 1)), F.lit(levels + 1))


def merge_trees(trees: Sequence[DataFrame], key: str, measures: Sequence[str]) -> DataFrame:
    """One tree of several with the same levels: that of all their facts together."""
    rows = trees[0]
    for tree in trees[1:]:
        rows = rows.unionByName(tree)
    rows = rows.withColumn("_level", F.explode(F.sequence("low", "upto")))
    nodes = rows.groupBy(key, SUBTREE, "_level", _node(F.col("at"), F.col("_level") - F.col("low")).alias("at")).agg(
        F.sum("facts").alias("facts"), F.max("newest").alias("newest"), *[F.sum(c).alias(c) for c in measures]
    )
    # Nodes with the same newest day lie in each other; those with as many facts are one chain.
    chains = nodes.groupBy(key, SUBTREE, F.col("newest.day").alias("_day"), "facts").agg(
        F.min("_level").alias("low"), F.min_by("at", "_level").alias("at"), F.max("_level").alias("upto"),
        F.max("newest").alias("newest"), *[F.max(c).alias(c) for c in measures],
    )
    return chains.select(key, SUBTREE, "low", "at", "upto", "facts", "newest", *measures)


def nodes_of(low: Column, high: Column, top: int = TOP_LEVEL) -> Column:
    """Array of (level, node) that together are the days of (low, high]; empty if there is none.

    From the lowest level up: a left end that is an odd node stays alone, as does a right end
    that follows an even one; the rest are pairs, that is nodes of the next level.
    """
    begin, end = _number(low) + 1, _number(high) + 1
    parts = []
    for level in range(top):
        # The first whole node at or after the begin, and the node the end lies in.
        a, b = -_node(-begin, level), _node(end, level)
        left, right = (a < b) & (F.pmod(a, F.lit(2)) == 1), (a < b) & (F.pmod(b, F.lit(2)) == 1)
        parts += [F.when(left, _pair(level, a)), F.when(right, _pair(level, b - 1))]
    a, b = -_node(-begin, top), _node(end, top)
    whole = F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), lambda n: _pair(top, n)))
    some = F.filter(F.array(*parts), lambda p: p.isNotNull())
    return F.concat(some, F.coalesce(whole, F.array().cast(f"array<{_PAIR}>")))


_PAIR = "struct<level:int,node:bigint>"


def _pair(level: int, node: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), node.alias("node"))


def subtrees_of(low: Column, high: Column, top: int = TOP_LEVEL) -> Column:
    """Array of the subtrees that the nodes of (low, high] lie in (``nodes_of``), each once.

    Below the blocks those are the ones that an end of the span cuts.
    """
    a, b = _number(low) + 1, _number(high) + 1
    *storeys, (first, _, root) = _storeys(top)
    none, parts = F.array().cast("array<bigint>"), []
    for below, _, up in storeys:
        left, right, size = _node(a, up - below), _node(b, up - below), F.lit(1 << (up - below))
        cut_left, cut_right = (a < b) & (F.pmod(a, size) > 0), (a < b) & (F.pmod(b, size) > 0)
        parts.append(F.when(cut_left, F.array(_level_node(left, up))).otherwise(none))
        parts.append(F.when(cut_right & ~(cut_left & (left == right)), F.array(_level_node(right, up))).otherwise(none))
        a, b = -_node(-a, up - below), right
    left, right = _node(a, root - first), _node(b - 1, root - first)
    whole = F.sequence(_level_node(left, root), _level_node(F.greatest(left, right), root), F.lit(1 << _LEVEL_BITS).cast("bigint"))
    return F.concat(*parts, F.when(a < b, whole).otherwise(none))


def totals_from_tree(
    spans: DataFrame, key: str, low: str, high: str, tree: DataFrame, measures: Sequence[str], top: int = TOP_LEVEL, parts: int | None = None
) -> DataFrame:
    """Per distinct span (low, high]: facts (0 if none), group of the newest fact, each measure.

    A measure is null where no value was known, as SQL's SUM. Spans may overlap and be of any
    length; one that is empty or has a null end keeps its row. ``parts`` deals spans and their
    sums into that many; a tree in buckets by entity and subtree is not shuffled.
    """
    ends = _dealt(spans.select(key, low, high), parts, key, low, high).distinct()
    cut = ends.select("*", F.explode_outer(subtrees_of(F.col(low), F.col(high), top)).alias(SUBTREE))
    # Days from the begin of a chain's lowest node to its end, and those of the node above the chain.
    at, level, up = F.col("at"), F.col("low"), F.col("upto") + 1
    above = F.when(up <= top, _node(at, up - level))
    days = {"_from": _begin(at, level), "_to": _begin(at + 1, level), "_above": _begin(above, up), "_above_to": _begin(above + 1, up)}
    newest = F.col("newest.day").alias("_day"), F.col("newest.group").alias("_group")
    chains = tree.select(key, SUBTREE, *[c.cast("int").alias(name) for name, c in days.items()], "facts", *newest, *measures)
    begin, end = F.unix_date(f"s.{low}") + 1, F.unix_date(f"s.{high}") + 1
    # The largest nodes inside the span: a chain begins in it, and the node above is not inside.
    inside = (F.col("t._from") >= begin) & (F.col("t._to") <= end)
    larger = F.coalesce((F.col("t._above") >= begin) & (F.col("t._above_to") <= end), F.lit(False))
    same = [F.col(f"s.{c}") == F.col(f"t.{c}") for c in (key, SUBTREE)]
    # A span is several rows here, which the planner's sizes do not show; neither side is sent whole.
    met = cut.alias("s").hint("merge").join(chains.alias("t"), [*same, inside & ~larger], "left")
    ends = [F.col(f"s.{c}").alias(c) for c in (key, low, high)]

    def sums(groups) -> DataFrame:
        # Nodes of a span share no day: the newest group needs no order among groups.
        newest = F.max("_day").alias("_day"), F.max_by("_group", "_day").alias("_group")
        return groups.agg(F.sum("facts").alias("facts"), *newest, *[F.sum(c).alias(c) for c in measures])

    # Per subtree first, where the nodes are: a span has up to three rows to be dealt out again.
    found = sums(met.groupBy(*ends, F.col(f"s.{SUBTREE}"))).drop(SUBTREE)
    totals = sums(_dealt(found, parts, key, low, high).groupBy(key, low, high))
    return totals.select(key, low, high, F.coalesce("facts", F.lit(0)).alias("facts"), F.col("_group").alias("group"), *measures)
