"""Boosted trees and forests over very many one-hot slots.

Spark's learner holds a row as one number per slot, so rows of a column with thousands of
categories fill memory and disk, and every level of every tree reads all of it. Here a row
holds only the slots that it has: the bin of each number and the one-hot slots that are 1. A
level of all trees is one aggregate by (tree, node, slot); what a node has beside a slot is the
rest of its total. Only each node's best split reaches the driver, which keeps trees anyway.

Candidates (thresholds of a number, one category against all others), gain (variance),
stopping rules and losses are those of Spark's learner. Two things differ: a number with more
than ``maxBins`` values is cut at its approximate quantiles over all rows, not over a sample, and
a forest's node looks at each slot with the chance of the share, not at a fixed number of them.
The result is Spark's own model, made through its saved format.

``fit`` takes this way only where Spark's learner would hold more than ``MOST_CELLS`` numbers.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressionModel,
    GBTRegressor,
    RandomForestRegressionModel,
    RandomForestRegressor,
)
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.sinks import fresh_path, stage

# Numbers that Spark's learner may hold for all rows together: 1 GB.
MOST_CELLS = 1 << 28
# Slots that are no one-hot slots; each is binned on its own.
MOST_NUMBERS = 1_000
_MODELS = {GBTRegressor: GBTRegressionModel, RandomForestRegressor: RandomForestRegressionModel}
_SHARES = {"auto": 1 / 3, "onethird": 1 / 3, "all": 1.0}
_NODES = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
    "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def fit(estimator: Estimator, df: DataFrame) -> Model:
    """The fitted regressor, by Spark's learner unless its rows would be too wide."""
    numbers = _numbers(estimator, df)
    if numbers is None:
        return estimator.fit(df)
    slots, numeric = numbers
    if slots * df.count() <= MOST_CELLS:
        return estimator.fit(df)
    return _Learner(estimator, df, slots, numeric).fit()


def _numbers(estimator: Estimator, df: DataFrame) -> tuple[int, list[int]] | None:
    """Number of slots and which are numbers; None for what only Spark's learner takes."""
    if type(estimator) not in _MODELS or any(p.name in ("weightCol", "validationIndicatorCol") for p in estimator._paramMap):
        return None
    if estimator.getFeatureSubsetStrategy() not in _SHARES or estimator.getMinWeightFractionPerNode() > 0:
        return None
    described = df.schema[estimator.getFeaturesCol()].metadata.get("ml_attr", {})
    attrs = described.get("attrs", {})
    numeric = sorted(a["idx"] for a in attrs.get("numeric", []))
    if not attrs or set(attrs) - {"numeric", "binary"} or len(numeric) > MOST_NUMBERS:
        return None
    return described["num_attrs"], numeric


@dataclass
class Node:
    """Count, sum and sum of squares of the targets; the split, if there is one."""

    n: float
    s: float
    q: float
    gain: float = -1.0
    slot: int = -1

    @property
    def value(self) -> float:
        return self.s / self.n if self.n else 0.0

    @property
    def impurity(self) -> float:
        return max(self.q / self.n - self.value**2, 0.0) if self.n else 0.0


# Nodes by their place: the root is 1, the children of i are 2i and 2i + 1.
Tree = dict[int, Node]


class _Learner:
    def __init__(self, estimator: Estimator, df: DataFrame, slots: int, numeric: list[int]):
        self.estimator, self.df, self.slots, self.numeric = estimator, df, slots, numeric
        self.spark: SparkSession = df.sparkSession
        self.bins, self.depth, self.seed = estimator.getMaxBins(), estimator.getMaxDepth(), estimator.getSeed()
        # Codes of bins come first, those of one-hot slots after them.
        self.base = len(numeric) * self.bins
        self.share = 1.0

    def fit(self) -> Model:
        rows = self._rows()
        forest = isinstance(self.estimator, RandomForestRegressor)
        trees, weights = self._forest(rows) if forest else self._boosted(rows)
        return self._model(trees, weights)

    # --- rows -------------------------------------------------------------------------

    def _rows(self) -> DataFrame:
        """(_y, _slots): the target and the codes that the row has."""
        label = F.col(self.estimator.getLabelCol()).cast("double")
        vector = F.unwrap_udt(F.col(self.estimator.getFeaturesCol()))
        dense, values, places = vector["type"] == 1, vector["values"], vector["indices"]
        pairs = F.when(
            dense, F.transform(values, lambda v, i: F.struct(i.alias("i"), v.alias("v")))
        ).otherwise(F.zip_with(places, values, lambda i, v: F.struct(i.alias("i"), v.alias("v"))))
        ones = F.filter(pairs, lambda p: (p["v"] != 0) & ~p["i"].isin(self.numeric) if self.numeric else p["v"] != 0)

        def number(i: int) -> Column:
            found = F.get(values, (F.array_position(places, F.lit(i)) - 1).cast("int"))
            return F.coalesce(F.when(dense, F.get(values, F.lit(i))).otherwise(found), F.lit(0.0))

        names = [f"_n{j}" for j in range(len(self.numeric))]
        raw = self.df.select(
            F.coalesce(label, F.raise_error(F.lit("a row has no label")).cast("double")).alias("_y"),
            F.transform(ones, lambda p: p["i"] + self.base).alias("_ones"),
            *[number(i).alias(n) for i, n in zip(self.numeric, names)],
        )
        raw = stage(raw, "tree_rows")
        self.cuts = self._cuts(raw, names)

        def code(name: str, j: int) -> Column:
            return F.size(F.filter(F.lit(self.cuts[j]), lambda cut: cut < F.col(name))) + j * self.bins

        binned = [j for j, c in enumerate(self.cuts) if c]
        # Where a row's codes hold the bin of each number.
        self.spots = {j: spot for spot, j in enumerate(binned)}
        codes = [code(names[j], j) for j in binned]
        return stage(raw.select("_y", F.concat(F.array(*codes).cast("array<int>"), "_ones").alias("_slots")), "tree_rows")

    def _cuts(self, raw: DataFrame, names: list[str]) -> list[list[float]]:
        """Thresholds of each number: between its values if they are few, else its quantiles."""
        if not names:
            return []
        shares = [i / self.bins for i in range(1, self.bins)]
        row = raw.agg(
            *[F.approx_count_distinct(n).alias(n) for n in names],
            *[F.percentile_approx(n, shares, 100 * self.bins).alias(f"{n}_cuts") for n in names],
        ).first()
        few = [n for n in names if row[n] <= 2 * self.bins]
        # Sets of few values, as counted above.
        sets = raw.agg(*[F.collect_set(n).alias(n) for n in few]).first() if few else {}
        out = []
        for n in names:
            known = sorted(sets[n]) if n in few else []
            if n in few and len(known) <= self.bins:
                out.append([(a + b) / 2 for a, b in zip(known, known[1:])])
            else:
                out.append(sorted(set(row[f"{n}_cuts"])))
        return out

    # --- ensembles --------------------------------------------------------------------

    def _boosted(self, rows: DataFrame) -> tuple[list[Tree], list[float]]:
        e = self.estimator
        trees, weights = [], []
        left = F.col("_y") - F.col("_f")
        later = F.when(left < 0, -1.0).otherwise(1.0) if e.getLossType() == "absolute" else 2 * left
        rows = rows.withColumn("_f", F.lit(0.0))
        for t in range(e.getMaxIter()):
            bag = F.lit(1) if e.getSubsamplingRate() >= 1 else (F.rand(self.seed + t) < e.getSubsamplingRate()).cast("int")
            target = later if trees else F.col("_y")
            rows = stage(rows.select("_y", "_f", "_slots", target.alias("_r"), F.array(bag).alias("_bag")), "boosted")
            (tree,), placed = self._grow(rows, 1)
            weight = e.getStepSize() if trees else 1.0
            trees.append(tree)
            weights.append(weight)
            values = [weight * tree[i].value if i in tree else 0.0 for i in range(2 << self.depth)]
            rows = placed.withColumn("_f", F.col("_f") + F.get(F.lit(values), "node")).drop("tree", "w", "node")
        return trees, weights

    def _forest(self, rows: DataFrame) -> tuple[list[Tree], list[float]]:
        e = self.estimator
        count, rate = e.getNumTrees(), e.getSubsamplingRate()
        strategy = e.getFeatureSubsetStrategy()
        self.share = 1.0 if strategy == "auto" and count == 1 else _SHARES[strategy]
        draws = F.array(*[F.rand(self.seed + t) for t in range(count)])
        if e.getBootstrap():
            # How often a row is drawn, from the steps of the Poisson distribution.
            steps, upto = [], 0.0
            for k in range(20):
                upto += math.exp(-rate) * rate**k / math.factorial(k)
                steps.append(upto)
            bag = F.transform("_draws", lambda u: F.size(F.filter(F.lit(steps), lambda s: s <= u)))
        else:
            bag = F.transform("_draws", lambda u: (u < rate).cast("int"))
        rows = rows.withColumn("_draws", draws).select(F.col("_y").alias("_r"), "_slots", bag.alias("_bag"))
        trees, _ = self._grow(stage(rows, "bags"), count)
        return trees, [1.0] * count

    # --- one tree, or all trees of a forest at once ------------------------------------

    def _grow(self, rows: DataFrame, count: int) -> tuple[list[Tree], DataFrame]:
        """Trees over _r, level by level, and a row for each row and tree with the place of its node."""
        of_tree = rows.select("_r", F.posexplode("_bag").alias("tree", "w")).groupBy("tree")
        w, r = F.col("w"), F.col("_r")
        sums = [F.sum(w).cast("double").alias("n"), F.sum(w * r).alias("s"), F.sum(w * r * r).alias("q")]
        roots = of_tree.agg(*sums).collect()
        trees: list[Tree] = [{1: Node(0.0, 0.0, 0.0)} for _ in range(count)]
        for root in roots:
            trees[root["tree"]][1] = Node(root["n"], root["s"], root["q"])
        rows = rows.select("*", F.posexplode("_bag").alias("tree", "w")).drop("_bag").withColumn("node", F.lit(1))
        for level in range(self.depth):
            first = 1 << level
            found = self._splits(rows, trees, first, sums)
            if not found:
                break
            steps = []
            for f in found:
                tree, place = trees[f["tree"]], f["node"]
                node, near = tree[place], Node(f["n"], f["s"], f["q"])
                far = Node(node.n - near.n, node.s - near.s, node.q - near.q)
                node.slot, node.gain = f["slot"], f["gain"]
                number = node.slot < self.base
                tree[2 * place], tree[2 * place + 1] = (near, far) if number else (far, near)
                # A row goes right by a higher bin of the number, or if it has the slot.
                spot, code = (self.spots[node.slot // self.bins], node.slot + 1) if number else (-1, node.slot)
                steps.append((f["tree"], place, spot, code))
            rows = self._stepped(rows, steps)
        return trees, rows

    def _stepped(self, rows: DataFrame, steps: list[tuple[int, int, int, int]]) -> DataFrame:
        """Rows of split nodes go on to a child; as many steps as a level has nodes."""
        table = F.broadcast(self.spark.createDataFrame(steps, "tree int, node int, _spot int, _code int"))
        spot, code = F.col("_spot"), F.col("_code")
        right = F.when(spot >= 0, F.get("_slots", spot) >= code).otherwise(F.array_contains("_slots", code))
        after = F.when(code.isNull(), F.col("node")).otherwise(2 * F.col("node") + right.cast("int"))
        return rows.join(table, ["tree", "node"], "left").withColumn("node", after).drop("_spot", "_code")

    def _splits(self, rows: DataFrame, trees: list[Tree], first: int, sums: list[Column]) -> list:
        """The best split of each node of a level that has one."""
        least = self.estimator.getMinInstancesPerNode()
        wanted = [
            (t, place, node.n, node.s, node.q)
            for t, tree in enumerate(trees)
            for place, node in tree.items()
            if place >= first and node.n >= 2 * least and node.impurity > 0
        ]
        if not wanted:
            return []
        # As many rows as the level has nodes.
        totals = self.spark.createDataFrame(wanted, "tree int, node int, _n double, _s double, _q double")
        each = rows.filter((F.col("w") > 0) & (F.col("node") >= first)).select("_r", "tree", "w", "node", F.explode("_slots").alias("slot"))
        feature = F.when(F.col("slot") < self.base, F.floor(F.col("slot") / self.bins).cast("int")).otherwise(F.col("slot"))
        if self.share < 1:
            looked = F.pmod(F.xxhash64(F.lit(self.seed), "tree", "node", feature), F.lit(1 << 30))
            each = each.filter(looked < int(self.share * (1 << 30)))
        upto = Window.partitionBy("tree", "node", "feature").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
        hist = each.groupBy("tree", "node", "slot").agg(*sums).withColumn("feature", feature)
        hist = hist.select("tree", "node", "slot", *[F.sum(c).over(upto).alias(c) for c in ("n", "s", "q")])
        hist = hist.join(F.broadcast(totals), ["tree", "node"])
        rest, other = F.col("_n") - F.col("n"), F.col("_s") - F.col("s")
        gain = (F.col("s") * F.col("s") / F.col("n") + other * other / rest - F.col("_s") * F.col("_s") / F.col("_n")) / F.col("_n")
        # Rounding alone is no gain.
        enough = F.lit(self.estimator.getMinInfoGain()) + 1e-12 * F.col("_q") / F.col("_n")
        hist = hist.filter((F.col("n") >= least) & (rest >= max(least, 1))).withColumn("gain", gain).filter(F.col("gain") > enough)
        best = F.max(F.struct("gain", (-F.col("slot")).alias("_turned"), "n", "s", "q", "slot")).alias("best")
        return hist.groupBy("tree", "node").agg(best).select("tree", "node", "best.*").collect()

    # --- the model --------------------------------------------------------------------

    def _listed(self, tree: Tree) -> Iterator[tuple]:
        """Nodes with the numbers of Spark's format: a node, its left part, its right part."""
        order: dict[int, int] = {}
        open_places = [1]
        while open_places:
            place = open_places.pop()
            order[place] = len(order)
            if tree[place].slot >= 0:
                open_places += [2 * place + 1, 2 * place]
        for place, number in order.items():
            node = tree[place]
            children, split = (-1, -1), (-1, [], -1)
            if node.slot >= 0:
                children = order[2 * place], order[2 * place + 1]
                at, step = divmod(node.slot, self.bins)
                number_split = node.slot < self.base
                split = (self.numeric[at], [self.cuts[at][step]], -1) if number_split else (node.slot - self.base, [0.0], 2)
            yield number, node.value, node.impurity, [node.n, node.s, node.q], int(node.n), node.gain, *children, split

    def _model(self, trees: list[Tree], weights: list[float]) -> Model:
        e, kind = self.estimator, _MODELS[type(self.estimator)]
        path = fresh_path(self.spark, "grown_model")

        def described(name: str, uid: str, params: dict, defaults: dict, **more) -> str:
            named = {k: {p.name: v for p, v in x.items()} for k, x in (("paramMap", params), ("defaultParamMap", defaults))}
            head = {"class": f"org.apache.spark.ml.regression.{name}", "timestamp": int(time.time() * 1000)}
            return json.dumps(head | {"sparkVersion": self.spark.version, "uid": uid} | named | more)

        whole = described(kind.__name__, e.uid, e._paramMap, e._defaultParamMap, numFeatures=self.slots, numTrees=len(trees))
        plain = DecisionTreeRegressor(maxDepth=self.depth, maxBins=self.bins)
        one = [described("DecisionTreeRegressionModel", f"{plain.uid}_{t}", plain._paramMap, plain._defaultParamMap) for t in range(len(trees))]
        listed = [(t, node) for t, tree in enumerate(trees) for node in self._listed(tree)]
        # Trees are small beside the rows they are grown from.
        make = self.spark.createDataFrame
        make([(whole,)], "value string").coalesce(1).write.text(f"{path}/metadata")
        make(list(zip(range(len(trees)), one, weights)), "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
        make(listed, _NODES).coalesce(1).write.parquet(f"{path}/data")
        return kind.load(path)
