"""Mixing sources by temperature: weights are token shares to a power, and the power is bisected.

A power of 1 leaves the shares as they are, 0 makes all sources equal. ``repetition_limit`` asks
for the smallest power at which no source is drawn more than that many times while the largest
is drawn once, so that nothing is dropped; ``entropy`` asks for the power whose weights have
that share of the largest possible entropy. Bisection evaluates a grid of powers at a time, as
an aggregate over the table of sources, so a few passes give the exponent to 12 digits however
many sources there are.

The weights are realised as budgeted block permutations: the documents of a source fall into
blocks by hash, each epoch permutes the blocks and the documents inside them, and the last epoch
takes blocks in that order until the source's budget is met, inside the last block document by
document. Sums run over blocks first, so no task holds a source.

Defined results: a null source is a source of its own; null and empty texts have no tokens and
appear once in every full epoch; null and repeated ids and repeated rows are drawn once each per
epoch; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import stored

GRID = 64
PASSES = 7  # 64 ** -7 is beyond double precision
BLOCK_ROWS = 512  # documents that share a block, on average
PART_BITS = 10  # parts of a source's permutation: one window holds at most 2**10 rows of a source
REPETITIONS = 2.0


def tokens(text: Column) -> Column:
    """White-space words, the token measure unless another is given."""
    bare = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r ]+", " "))
    return F.when(bare == "", 0).otherwise(
        F.length(bare) - F.length(F.translate(bare, " ", "")) + 1
    ).cast("long")


def exponent(sources: DataFrame, repetition_limit: float | None, entropy: float | None) -> float:
    """The power that meets the target; ``sources`` has one row (source, tokens) each."""
    used = sources.where("tokens > 0")
    total = used.agg(F.sum("tokens")).head()[0]
    if not total:
        return 1.0
    share = used.select((F.col("tokens") / F.lit(float(total))).alias("p"))
    low, high = 0.0, 1.0
    for _ in range(PASSES):
        step = (high - low) / GRID
        grid = [low + step * i for i in range(GRID + 1)]
        powers = share.select("p", F.explode(F.array(*map(F.lit, grid))).alias("a"))
        raised = F.pow("p", "a")
        stats = powers.groupBy("a").agg(
            F.sum(raised).alias("z"),
            F.sum(raised * F.log(raised)).alias("s"),
            F.max(raised / F.col("p")).alias("most"),
            F.min(raised / F.col("p")).alias("least"),
            F.count("*").alias("n"),
        )
        if repetition_limit is not None:
            met = F.col("most") / F.col("least") <= repetition_limit
        else:
            spread = (F.log("z") - F.col("s") / F.col("z")) / F.greatest(F.log("n"), F.lit(1e-300))
            met = spread <= entropy
        # Both grow flatter as the power falls: the target holds from some power upwards.
        first = stats.where(met).agg(F.min("a")).head()[0]
        if first is None:
            return 1.0
        if first == low:
            return low
        low, high = first - step, first
    return high


def mix_sources(
    df: DataFrame,
    repetition_limit: float | None = REPETITIONS,
    entropy: float | None = None,
    seed: int = 1,
    budget: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """(row, source, n_tokens, weight, repetitions, epoch, block, block_order, doc_order).

    One row per document drawn and epoch; ``row`` holds the columns of ``df``. Ordering by epoch,
    block_order and doc_order gives a source's permutation. Without ``budget`` (in tokens over
    all sources) the budget is the least that draws every source at least once.
    """
    if (repetition_limit is None) == (entropy is None):
        raise ValueError("give a repetition limit or a target entropy")
    # Written once with its token counts: what follows reads single columns until the last step.
    measured = df.select(
        F.struct("*").alias("row"),
        F.col(source_col).alias("source"),
        tokens(F.col(text_col)).alias("n_tokens"),
        F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("doc"),
    )
    rows = stored(measured, "measured")
    sources = stored(
        rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")),
        "sources",
    )
    power = exponent(sources, repetition_limit, entropy)
    raised = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(power))).otherwise(0.0)
    sums = sources.agg(
        F.sum(raised).alias("z"), F.max(F.when(raised > 0, F.col("tokens") / raised)).alias("scale")
    ).head()
    z, scale = sums["z"] or 1.0, sums["scale"] or 1.0
    factor = scale if budget is None else budget / z
    plan = stored(
        sources.select(
            "source",
            (raised / F.lit(z)).alias("weight"),
            F.when(F.col("tokens") > 0, F.round(raised * F.lit(factor) / F.col("tokens"), 12))
            .otherwise(1.0).alias("repetitions"),
            F.round(raised * F.lit(factor)).cast("long").alias("budget"),
            "tokens",
            F.ceil(F.col("docs") / BLOCK_ROWS).alias("blocks"),
        ),
        "mixing-plan",
    )
    # The table of sources may be large or hold one hot source: adaptive joins split it.
    drawn = rows.join(plan, rows.source.eqNullSafe(plan.source)).drop(plan.source)
    drawn = drawn.withColumn("block", F.pmod("doc", "blocks"))
    full = F.floor("repetitions").cast("int")
    epochs = F.sequence(F.lit(0), F.when(full < F.col("repetitions"), full).otherwise(full - 1))
    drawn = drawn.withColumn("full", full).withColumn(
        "epoch", F.explode(F.when(F.col("repetitions") > 0, epochs).otherwise(F.array()))
    )
    drawn = drawn.withColumn(
        "block_order", F.xxhash64(F.lit(seed), F.col("source"), F.col("epoch"), F.col("block"))
    ).withColumn("doc_order", F.xxhash64(F.col("doc"), F.col("epoch")))

    last = drawn.where("epoch = full")
    group = ["source", "block", "block_order"]
    sizes = last.groupBy(*group).agg(
        F.sum("n_tokens").alias("size"),
        F.first(F.col("budget") - F.col("full") * F.col("tokens")).alias("left"),
    )
    # Sums over parts of the permutation first, then inside a part: no task sorts a source's blocks.
    sizes = stored(sizes.withColumn("part", F.shiftright("block_order", 64 - PART_BITS)), "block-sizes")
    earlier = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("source", "part").agg(F.sum("size").alias("size"))
    parts = parts.select(
        F.col("source").alias("s"), F.col("part").alias("p"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("parts_before"),
    )
    within = F.sum("size").over(
        W.partitionBy("source", "part").orderBy("block_order", "block").rowsBetween(W.unboundedPreceding, -1)
    )
    sizes = sizes.withColumn("within", F.coalesce(within, F.lit(0)))
    sizes = sizes.join(parts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    sizes = sizes.withColumn("before", F.col("parts_before") + F.col("within")).drop("s", "p")
    opened = stored(
        sizes.where("before < left").select(
            F.col("source").alias("s"), F.col("block").alias("b"), "before", "left",
            (F.col("before") + F.col("size") > F.col("left")).alias("cut"),
        ),
        "opened-blocks",
    )
    last = last.join(
        opened, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
    )
    inside = F.sum("n_tokens").over(
        W.partitionBy("source", "block").orderBy("doc_order", "doc")
        .rowsBetween(W.unboundedPreceding, -1)
    )
    columns = [
        "row", "source", "n_tokens", "weight", "repetitions", "epoch",
        "block", "block_order", "doc_order",
    ]
    cut = last.where("cut").withColumn("inside", F.coalesce(inside, F.lit(0)))
    cut = cut.where(F.col("before") + F.col("inside") < F.col("left"))
    return (
        drawn.where("epoch < full").select(columns)
        .union(last.where("NOT cut").select(columns))
        .union(cut.select(columns))
    )
