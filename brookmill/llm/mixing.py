"""Mixing sources to target weights by entropy balancing.

Every document gets a rate (copies taken) as close as possible, in relative entropy, to
one base rate for all, under two rules: each source's expected words equal its target,
and no rate exceeds ``most``. The optimum is an exponential tilt by document size: with
``x`` the size in units of its source's mean, ``odds(rate / most) = odds(base / most) *
exp(multiplier * x)``. The multipliers solve the convex dual, one per source: Newton steps
whose gradients and curvatures are sums over a table of (source, size, documents), which
Spark folds once per step; a bracket keeps each step safe. Sources and multipliers stay
in tables, the driver sees a few scalars.

Rates are rounded into whole copies by a digest of the id, so that reruns agree; what a
source then lacks or has too much is settled along a second digest order: the first
documents give up or fill up what they can, the last of them in part.

Targets share ``share`` times all sizes by weight and stop at ``most`` times their
source's size; the excess is shared again until none is above.

Defined cases: a null text has size 0 and takes nothing; a null source is a source of its
own, last in order; rows that repeat id, text and source get one decision; an
empty table gives an empty result; columns of the table stay, but for ones named like the
added ones.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage
from .common import ID, ROW, TEXT, held_rows, released, words

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2
TOLERANCE = 1e-9  # of a target
SLOTS = 4096  # of the digest order in which residues are settled
NULL_LAST = ("_null", "source")
MADE = ("size", "source_size", "target", "rate", "taken")


def source_targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, size)`` with ``weight`` and ``target``. Raises the common level of
    target per weight until the sources that stay below their cap carry the excess."""
    spark = sources.sparkSession
    ordered = sources.withColumn("_null", F.col("source").isNull())
    # numbers sources without one task holding them all: ranges first, offsets after
    placed = cut_lineage(ordered.orderBy(*NULL_LAST).withColumn("_at", F.monotonically_increasing_id()))
    block = F.shiftright("_at", 33)
    first = placed.groupBy(block.alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    first = first.withColumn("_before", F.coalesce(F.sum("n").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))
    table = placed.withColumn("_b", block).join(first.select("_b", "_before"), "_b").withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (number % len(weights)).cast("int") + 1))
    table = cut_lineage(table.select("source", "size", "weight"))
    cap, total = F.col("size") * most, table.agg(F.sum("size").alias("n")).first()["n"] or 0
    level = 0.0
    while True:
        full = cap <= F.lit(level) * F.col("weight")
        left = table.agg(
            F.sum(F.when(full, cap).otherwise(0)).alias("given"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("weight")
        ).first()
        if not left["weight"]:
            break
        above = (share * total - left["given"]) / left["weight"]
        if above <= level:
            break
        level = above
    return table.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def base_odds(share: float, most: int) -> float:
    base = min(share, most * 0.999)
    return math.log(base / (most - base))


def _rate(base: float, most: int, multiplier: Column, x: Column) -> Column:
    return most / (1 + F.exp(-(F.lit(base) + multiplier * x)))


def multipliers(sizes: DataFrame, targets: DataFrame, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(source, target, mean, multiplier)`` of the tilt; ``sizes`` has (source, size, n).

    A source that must be taken ``most`` times in full has an infinite multiplier, one
    without words 0.
    """
    base = base_odds(share, most)
    mean = F.when(F.col("size") > 0, F.col("size") / F.col("docs")).otherwise(1.0)
    docs = sizes.groupBy("source").agg(F.sum("n").alias("docs"))
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    state = targets.join(docs.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "source", "size", "target", mean.alias("mean"),
        F.when(F.col("size") == 0, 0.0).when(F.col("target") >= most * F.col("size"), float("inf")).otherwise(0.0).alias("multiplier"),
        F.lit(float("-inf")).alias("low"), F.lit(float("inf")).alias("high"), (F.col("size") == 0).alias("done"),
    )
    state = state.withColumn("done", F.col("done") | (F.col("target") >= most * F.col("size")))
    state = cut_lineage(state)
    while state.filter(~F.col("done")).limit(1).count():
        s, z = state.alias("s"), sizes.withColumnsRenamed({"size": "words"}).alias("z")
        x = F.col("words") / F.col("mean")
        rate = _rate(base, most, F.col("multiplier"), x)
        sums = (
            z.join(s, same(z, s)).filter(~F.col("done")).groupBy(F.col("s.source").alias("_s"))
            .agg(F.sum(F.col("n") * F.col("words") * rate).alias("taken"),
                 F.sum(F.col("n") * F.col("words") * x * rate * (1 - rate / most)).alias("slope"))
        )
        over = F.col("taken") - F.col("target")
        low = F.when(over < 0, F.greatest("low", "multiplier")).otherwise(F.col("low"))
        high = F.when(over > 0, F.least("high", "multiplier")).otherwise(F.col("high"))
        newton = F.col("multiplier") - over / F.col("slope")
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        # outside of the bracket, or with no slope left: halve it, or widen an open side
        safe = (
            F.when(F.col("low") == float("-inf"), F.least(F.col("high") * 2, F.lit(-1.0)))
            .when(F.col("high") == float("inf"), F.greatest(F.col("low") * 2, F.lit(1.0)))
            .otherwise((F.col("low") + F.col("high")) / 2)
        )
        stepped = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("low", low).withColumn("high", high)
        close = (F.abs(over) <= TOLERANCE * F.col("target")) | (F.col("high") - F.col("low") <= 1e-12 * F.abs(F.col("multiplier")))
        step = F.when(inside & (F.col("slope") > 0), newton).otherwise(safe)
        state = cut_lineage(stepped.select(
            "source", "size", "target", "mean",
            F.when(F.col("done") | close, F.col("multiplier")).otherwise(step).alias("multiplier"),
            "low", "high", (F.col("done") | F.coalesce(close, F.lit(False))).alias("done"),
        ))
    # rounded, so that the order of floating-point sums decides nothing
    return state.select("source", "size", "target", "mean", F.round("multiplier", 6).alias("multiplier"))


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """All rows with ``size`` (words), ``source_size``, ``target`` (both of the source),
    ``rate`` and ``taken`` (words the mix takes, repeats counted)."""
    own = _joined(docs, weights, share, most, id_col, text_col, source_col)
    return released(own, docs.columns, text_col, **{c: F.col(c) for c in MADE})


def _joined(docs, weights, share, most, id_col, text_col, source_col) -> DataFrame:
    """Held rows with their part of the mix."""
    rows = held_rows(docs, id_col, text_col).withColumn("source", F.col(f"{ROW}.`{source_col}`"))
    found = mixed(rows, weights, share, most).groupBy(F.col(ID).alias("_i"), F.col("_hash").alias("_h"), F.col("source").alias("_s"))
    table = found.agg(*[F.min(c).alias(c) for c in MADE])
    return rows.join(table, (F.col(ID) == F.col("_i")) & (F.xxhash64(TEXT) == F.col("_h")) & F.col("source").eqNullSafe(F.col("_s")))


def copies(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST,
           id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: each row as often as it is taken in full, and once more with its
    first words (as they stand in the text) where the last copy is taken in part."""
    rows = _joined(docs, weights, share, most, id_col, text_col, source_col).filter(F.col("taken") > 0)
    full, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    takes = F.concat(F.array_repeat(F.lit(None).cast("bigint"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select(ROW, TEXT, F.explode(takes).alias("_words"))
    with_blanks = F.regexp_extract_all(TEXT, F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1))
    head = F.array_join(F.slice(with_blanks, F.lit(1), F.col("_words").cast("int")), "")
    return released(rows, docs.columns, text_col, **{text_col: F.when(F.col("_words").isNull(), F.col(TEXT)).otherwise(head)})


def mixed(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The mix of rows (id, text, source) without their texts."""
    small = cut_lineage(rows.select(ID, F.xxhash64(TEXT).alias("_hash"), "source", F.size(words(F.col(TEXT))).cast("bigint").alias("size")))
    sizes = cut_lineage(small.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")))
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size"))
    tilts = multipliers(sizes, source_targets(sources, weights, share, most), share, most)
    tilts = tilts.withColumnsRenamed({"source": "_s", "size": "source_size"})
    base = base_odds(share, most)
    draw = lambda k: F.pmod(F.xxhash64(F.lit(k), ID, "_hash"), F.lit(2**52)) / 2.0**52
    rate = F.when(F.col("size") == 0, 0.0).otherwise(_rate(base, most, F.col("multiplier"), F.col("size") / F.col("mean")))
    whole = F.floor(F.col("rate") + draw(1)) * F.col("size")
    taken = cut_lineage(
        small.join(tilts, F.col("source").eqNullSafe(F.col("_s"))).withColumn("rate", rate)
        .select(ID, "_hash", "source", "size", "source_size", "target", "rate", whole.cast("bigint").alias("whole"),
                F.floor(draw(2) * SLOTS).cast("int").alias("slot"), draw(2).alias("u"))
    )
    # what is left to settle per source, and how much each slot of the order can give
    lacks = F.round(F.col("target")).cast("bigint") - F.col("taken")
    per_slot = taken.groupBy("source", "slot", "target").agg(
        F.sum("whole").alias("taken"), F.sum(F.col("size") * most - F.col("whole")).alias("room"))
    source = W.partitionBy("source")
    per_slot = per_slot.withColumn("taken", F.sum("taken").over(source)).withColumn("lack", lacks)
    reserve = F.when(F.col("lack") > 0, F.col("room")).otherwise(F.col("given"))
    per_slot = per_slot.join(
        taken.groupBy(F.col("source").alias("_s"), F.col("slot").alias("_t")).agg(F.sum("whole").alias("given")),
        F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_t")),
    ).withColumn("reserve", reserve)
    before = source.orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    per_slot = per_slot.withColumn("before", F.coalesce(F.sum("reserve").over(before), F.lit(0))).select(
        F.col("source").alias("_s"), F.col("slot").alias("_t"), "lack", "before", "reserve")
    joined = taken.join(per_slot, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slot") == F.col("_t")))
    size_left = F.abs("lack") - F.col("before")
    mine = F.when(F.col("lack") > 0, F.col("size") * most - F.col("whole")).otherwise(F.col("whole"))
    # whole slots first; one slot per source is settled row by row
    edge = (size_left > 0) & (size_left < F.col("reserve"))
    inside = W.partitionBy("source", "slot").orderBy("u", ID, "_hash").rowsBetween(W.unboundedPreceding, -1)
    settled = joined.withColumn("part", F.when(size_left >= F.col("reserve"), mine).otherwise(F.lit(0)))
    at_edge = joined.filter(edge).withColumn("_mine", mine)
    at_edge = at_edge.withColumn("part", F.least(F.col("_mine"), F.greatest(F.lit(0), size_left - F.coalesce(F.sum("_mine").over(inside), F.lit(0))))).drop("_mine")
    both = settled.filter(~edge).unionByName(at_edge)
    change = F.when(F.col("lack") > 0, F.col("part")).otherwise(-F.col("part"))
    return both.select(ID, "_hash", "source", "size", "source_size", "target", "rate", (F.col("whole") + change).cast("bigint").alias("taken"))
