"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions.

A document of a source is wanted target / size-of-source times: its whole part is copied
for certain, its fractional part is rounded. Rounding takes fractional documents in pairs
and moves words of expectation from one to the other, at random but without changing
their sum or anyone's expectation, until one of them is wholly in or out. So a source's
words stay what they were, but for the one document that is left over at the end, often a
large one, and goes to the nearer side. That miss is made up by turning round a few small
documents (``_nearer``), so a source's taken words are within half a small document.

Pairs are made in a tree: hashed blocks of about ``BLOCK`` documents are folded to one
residual each, the residuals are blocked and folded again, until a source has one. The
levels are as many as the logarithm of the largest source; each is written to the shared
folder. A source of any size is spread over its blocks.

Defined results: a null or blank text has size 0 and is taken 0 times; a null source is a
source of its own, the last one; rows that share doc_id, source and size are taken
equally often; ties and order do not matter, as random numbers are hashes of the ids, so
reruns agree; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.frames import stage

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
BLOCK = 64
SEED = 20240607
_UNIT = "struct<doc_id:bigint,size:bigint,rows:bigint,mass:double>"
_DONE = "struct<doc_id:bigint,size:bigint,rows:bigint,mass:double,done:boolean>"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, n_docs and the target of each source of sizes.

    In the order of the size a weight unit may grow to, sources are full as long as the
    rest, shared by weight, reaches their most. All windows here run over one row for each
    source.
    """
    wide = lambda c: c.cast("decimal(19,0)")
    per = sizes.groupBy("source").agg(F.sum("source_size").alias("source_size"), F.sum("n_docs").alias("n_docs"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(w).cast("bigint") for w in weights])
    per = per.withColumn("_weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    per = per.withColumn("_most", F.col("source_size") * most)
    order = W.orderBy(F.col("_most") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(0, W.unboundedFollowing)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    per = per.withColumns(
        {
            "_left": F.sum("source_size").over(whole) - F.coalesce(F.sum("_most").over(before), F.lit(0)),
            "_weights": F.sum("_weight").over(after),
            "_at": F.row_number().over(order),
        }
    )
    full = wide(F.col("_left")) * wide(F.col("_weight")) >= wide(F.col("_most")) * wide(F.col("_weights"))
    per = per.withColumn("_full", full)
    shares = F.min(F.when(~F.col("_full"), F.struct("_at", "_left", "_weights"))).over(whole)
    per = per.withColumn("_share", shares)
    shared = F.col("_weight") * F.col("_share._left") / F.col("_share._weights")
    return per.select(
        "source", "source_size", "n_docs", F.when(F.col("_full"), F.col("_most").cast("double")).otherwise(shared).alias("target")
    )


def _chance(*columns: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns, F.lit(SEED)), F.lit(1 << 53)) / F.lit(float(1 << 53))


def _fold(items: Column, level: int) -> Column:
    """Rounds an array of units in order: all but the last of the result are in or out."""

    def decided(unit: Column, mass: Column) -> Column:
        return F.struct(unit["doc_id"], unit["size"], unit["rows"], mass.alias("mass"), F.lit(True).alias("done")).cast(_DONE)

    def with_mass(unit: Column, mass: Column) -> Column:
        return F.struct(unit["doc_id"], unit["size"], unit["rows"], mass.alias("mass")).cast(_UNIT)

    def pair(state: Column, b: Column) -> Column:
        a, out = state["open"], state["out"]
        up, down = F.least(a["size"] - a["mass"], b["mass"]), F.least(a["mass"], b["size"] - b["mass"])
        rises = _chance(a["doc_id"], a["size"], b["doc_id"], b["size"], F.lit(level)) * (up + down) < down
        none, a_size, b_size = F.lit(0.0), a["size"].cast("double"), b["size"].cast("double")
        # Who is decided, with what, and who stays open with what.
        a_in = F.struct(with_mass(b, b["mass"] - up).alias("open"), F.concat(out, F.array(decided(a, a_size))).alias("out"))
        b_out = F.struct(with_mass(a, a["mass"] + up).alias("open"), F.concat(out, F.array(decided(b, none))).alias("out"))
        a_out = F.struct(with_mass(b, b["mass"] + down).alias("open"), F.concat(out, F.array(decided(a, none))).alias("out"))
        b_in = F.struct(with_mass(a, a["mass"] - down).alias("open"), F.concat(out, F.array(decided(b, b_size))).alias("out"))
        return (
            F.when(rises & (up == a["size"] - a["mass"]), a_in)
            .when(rises, b_out)
            .when(down == a["mass"], a_out)
            .otherwise(b_in)
        )

    start = F.struct(items[0].cast(_UNIT).alias("open"), F.expr(f"cast(array() as array<{_DONE}>)").alias("out"))
    folded = F.aggregate(F.slice(items, F.lit(2), F.size(items)), start, pair)
    last = folded["open"]
    rest = F.struct(last["doc_id"], last["size"], last["rows"], last["mass"], F.lit(False).alias("done")).cast(_DONE)
    return F.concat(folded["out"], F.array(rest))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """For each (doc_id, source, size) of docs: rows, source_size, target and copies."""
    sized = docs.select("doc_id", "source", word_count().alias("size"))
    units = stage(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows")), "mix-units")
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    plan = stage(targets(sizes, weights, most), "mix-targets")
    largest = plan.agg(F.max("n_docs")).first()[0] or 0

    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    mine = plan.withColumnRenamed("source", "_source")
    all_units = (
        units.join(mine, F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("_whole", F.floor(wanted).cast("bigint"))
        .withColumn("mass", (wanted - F.col("_whole")) * F.col("size") * F.col("rows"))
    )
    block = lambda blocks, level: F.pmod(F.xxhash64("doc_id", "size", F.lit(level)), blocks)
    blocks = F.ceil(F.col("n_docs") / BLOCK)
    level, many = 0, largest
    # A unit of several rows is rounded as one of their joint size.
    open_units = all_units.filter("size > 0 and mass > 0").select(
        "source", blocks.alias("_blocks"), "doc_id", (F.col("size") * F.col("rows")).alias("size"), "rows", "mass"
    )
    decided = []
    while many > 0:
        unit = F.struct("doc_id", "size", "rows", "mass")
        folded = (
            open_units.groupBy("source", "_blocks", block(F.col("_blocks"), level).alias("_block"))
            .agg(F.array_sort(F.collect_list(unit)).alias("_units"))
            .select("source", "_blocks", F.inline(_fold(F.col("_units"), level)))
        )
        folded = stage(folded, f"mix-level{level}")
        decided.append(folded.filter("done"))
        rest = folded.filter("not done").drop("done")
        level, many = level + 1, -(-many // BLOCK) if many > BLOCK else 0
        last = F.col("_blocks") == 1
        final = F.when(F.col("mass") * 2 >= F.col("size"), F.col("size")).otherwise(0)
        decided.append(rest.filter(last).withColumn("mass", final.cast("double")))
        open_units = rest.filter(~last).withColumn("_blocks", F.ceil(F.col("_blocks") / BLOCK))
    chosen = None
    for part in decided:
        part = part.filter("mass > 0").select("source", "doc_id", (F.col("size") / F.col("rows")).cast("bigint").alias("size"))
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        extra = all_units.withColumn("_extra", F.lit(0))
    else:
        picked = chosen.select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"), F.col("size").alias("_z"), F.lit(1).alias("_extra"))
        same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("size") == F.col("_z"))
        extra = all_units.join(picked, same, "left")
    count = F.when(F.col("size") == 0, 0).otherwise(F.col("_whole") + F.coalesce("_extra", F.lit(0)))
    free = (F.col("size") > 0) & (F.col("mass") > 0)
    each = extra.select(
        "doc_id", "source", "size", "rows", "source_size", "target", count.cast("bigint").alias("copies"), free.alias("free"), F.coalesce("_extra", F.lit(0)).alias("extra")
    )
    return _nearer(stage(each, "mix-rounded"))


def _nearer(each: DataFrame) -> DataFrame:
    """Turns round a few small units of each source, so that its words meet the target.

    What is missing (or too much) after the tree is at most half a large document. It is made
    up from units that were rounded down (or up), the largest that fit first: counts per size
    decide how many of each size, hashes which ones. Less than half of the smallest such unit
    is left, unless there are too few.
    """
    whole = F.col("size") * F.col("rows")
    missing = each.groupBy("source").agg((F.max("target") - F.sum(whole * F.col("copies"))).alias("_missing"))
    mine = missing.select(F.col("source").alias("_source"), "_missing")
    joined = each.filter("free").join(mine, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    need, up = F.abs("_missing"), F.col("_missing") > 0
    able = joined.filter((F.col("extra") == F.when(up, 0).otherwise(1)) & (whole <= 2 * need)).withColumn("_unit", whole)
    # As many rows for a source as it has different sizes below what is missing.
    sizes = able.groupBy("source", "_missing", "_unit").agg(F.count(F.lit(1)).alias("_n"))
    listed = sizes.groupBy("source", "_missing").agg(F.reverse(F.array_sort(F.collect_list(F.struct("_unit", "_n")))).alias("_sizes"))

    def take(state: Column, c: Column) -> Column:
        k = F.least(c["_n"], F.floor(state["left"] / c["_unit"]))
        pick = F.struct(c["_unit"].alias("unit"), c["_n"].alias("n"), k.alias("k"))
        return F.struct((state["left"] - k * c["_unit"]).alias("left"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    start = F.struct(need.alias("left"), F.expr("cast(array() as array<struct<unit:bigint,n:bigint,k:bigint>>)").alias("picks"))
    done = listed.select("source", F.aggregate("_sizes", start, take).alias("_d"))
    least = F.element_at("_d.picks", -1)["unit"]
    picks = done.select("source", F.col("_d.left").alias("_left"), least.alias("_least"), F.inline("_d.picks"))
    # The smallest unit once more where that comes nearer.
    more = (F.col("unit") == F.col("_least")) & (2 * F.col("_left") > F.col("unit")) & (F.col("k") < F.col("n"))
    picks = picks.select(F.col("source").alias("_source"), F.col("unit").alias("_u"), (F.col("k") + more.cast("bigint")).alias("_k")).filter("_k > 0")
    picks = stage(picks, "mix-picks")
    most = picks.agg(F.max("_k")).first()[0] or 0
    order = W.partitionBy("source", "_unit").orderBy(F.xxhash64("doc_id", "size", F.lit(SEED)), "doc_id", "size")
    # The first bound is the same for all, so Spark applies it before the shuffle.
    ranked = able.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= most)
    turned = ranked.join(picks, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_unit") == F.col("_u"))).filter("_at <= _k")
    turned = turned.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("size").alias("_z"), (1 - 2 * F.col("extra")).alias("_turn"))
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    out = each.join(turned, same, "left").withColumn("copies", F.col("copies") + F.coalesce("_turn", F.lit(0)))
    return out.select("doc_id", "source", "size", "rows", "source_size", "target", F.col("copies").cast("bigint").alias("copies"))


def mix_report(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every row of docs."""
    each = copies(docs, weights, most).withColumn("_row", F.explode(F.expr("sequence(1, rows)")))
    return each.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The rows of docs, each as often as the mix takes it."""
    found = copies(docs, weights, most).filter("copies > 0")
    found = found.select(F.col("doc_id").alias("_d"), F.col("source").alias("_src"), F.col("size").alias("_z"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_src")) & (F.col("_size") == F.col("_z"))
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "source", word_count().alias("_size"))
    return rows.join(found, same).select("_row", F.explode(F.expr("sequence(1, copies)"))).select("_row.*")
