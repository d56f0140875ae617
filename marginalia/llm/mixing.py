"""Mix sources to target weights: rake token counts to source, language and topic shares, then draw documents.

Iterative proportional fitting scales the cells of the source by language by topic table until the shares of each of the
three meet their targets. The probability of a cell's documents is its factor times a scale, at most 1. The scale is solved for a
budget, a share of all tokens: what is too rare for its target stays whole and leaves the rest of its budget to the others, in
proportion to their factors. Without a budget the scale is one by the largest factor, so that no probability is cut off and
the drawn tokens meet the targets in expectation; then the rarest cell decides how much is drawn. All of it is DataFrame
operations; only the largest deviation of a sweep, or the sums of a step to the scale, reach the driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import shielded, unshielded, written

DIMENSIONS = ("source", "lang", "topic")
NONE = ""
#: Share of all tokens that the registered query and the pipeline draw in expectation.
BUDGET = 0.7


def topic_bucket(text: Column, buckets: int = 8) -> Column:
    """A topic label for texts that carry none: the bucket of the longest word, the smallest of equals.

    Near copies mostly share it. Give a column of real topics to ``mixed`` where there is one.
    """
    words = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.length(w).alias("n"), F.hash(w).alias("h"), w.alias("w"))))
    return F.concat(F.lit("t"), F.pmod(F.crc32(longest["w"].cast("binary")), F.lit(buckets)).cast("string"))


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), "")).cast("long")


def flattened(cells: DataFrame, dimension: str, power: float = 0.7) -> DataFrame:
    """Target shares in proportion to the present share raised to ``power``: value, target."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").alias("tokens"))
    raised = sums.where("tokens > 0").select("value", F.pow(F.col("tokens").cast("double"), F.lit(power)).alias("raised"))
    total = raised.agg(F.sum("raised").alias("all"))
    return raised.join(total).select("value", (F.col("raised") / F.col("all")).alias("target"))


def rake(
    cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = 1e-6, most_sweeps: int = 30
) -> tuple[DataFrame, int]:
    """``cells`` (the dimensions and tokens) with ``factor``, and the number of sweeps.

    ``targets`` gives value and target share for each dimension; shares of values that no cell with tokens has are dealt to the
    others in proportion. A value without a target has share 0: its factor becomes 0. Cells without tokens weigh nothing, and
    are scaled with their values. Sweeps end when every share is within ``tolerance`` of its target.
    """
    total = cells.agg(F.sum("tokens").alias("all"))
    held = cells.join(total).withColumns({
        "factor": F.lit(1.0), "weight": F.coalesce(F.try_divide("tokens", "all"), F.lit(0.0))}).drop("all")
    for d, wanted in targets.items():
        present = cells.where("tokens > 0").select(F.col(d).alias("value")).distinct()
        found = wanted.join(present, "value", "left_semi")
        shares = found.join(found.agg(F.sum("target").alias("all"))).select(
            F.col("value").alias(d), F.coalesce(F.try_divide("target", "all"), F.lit(0.0)).alias(f"target_{d}"))
        held = held.join(shares, d, "left")
    held = written(held.fillna(0.0, [f"target_{d}" for d in targets]), "raked")
    sweeps = 0
    while sweeps < most_sweeps:
        off = F.lit(0.0)
        for d in targets:
            # After this step the mass of each value is its target, and that of all cells 1.
            mass = held.groupBy(d).agg(F.sum(F.col("weight") * F.col("factor")).alias("mass"))
            by = F.coalesce(F.try_divide(F.col(f"target_{d}"), F.col("mass")), F.lit(1.0))
            held = held.join(mass, d).withColumn("factor", F.col("factor") * by)
            off = F.greatest(off, F.abs(F.col("mass") - F.col(f"target_{d}")))
            held = held.withColumn("off", off).drop("mass")
            off = F.col("off")
        held = written(held, "raked")
        sweeps += 1
        worst = held.agg(F.max("off")).first()[0]
        held = held.drop("off")
        if worst is None or worst <= tolerance:
            break
    return held.select(*cells.columns, "factor"), sweeps


def scale_for(raked: DataFrame, budget: float) -> float:
    """The scale c with which the tokens times min(1, c * factor) come to ``budget`` of all tokens.

    Infinite if the tokens of all cells with a factor are no more than that. Newton's steps on a concave function of
    straight pieces come from below and end on the piece that holds the answer.
    """
    flow = F.col("tokens") * F.col("factor")
    start = raked.agg(F.sum("tokens"), F.sum(flow), F.sum(F.when(F.col("factor") > 0, F.col("tokens")))).first()
    wanted = budget * (start[0] or 0)
    if not start[1] or wanted >= start[2]:
        return math.inf
    scale = wanted / start[1]
    while True:
        whole = F.col("factor") * scale >= 1
        held, slope = raked.agg(
            F.sum(F.when(whole, F.col("tokens")).otherwise(0)), F.sum(F.when(whole, 0.0).otherwise(flow))).first()
        if not slope or (better := (wanted - held) / slope) <= scale * (1 + 1e-12):
            return scale
        scale = better


def mixed(
    docs: DataFrame,
    targets: dict[str, DataFrame] | None = None,
    topic: Column | None = None,
    text_col: str = "text",
    key_cols: tuple[str, ...] = ("doc_id",),
    seed: int = 7,
    power: float = 0.7,
    budget: float | None = None,
) -> DataFrame:
    """The rows of ``docs`` with topic, tokens, probability and drawn.

    ``docs`` has source and lang. Null values of a dimension are one value of their own, the empty string. The draw compares
    a hash of the key, the text and ``seed`` with the probability, so repeated rows share one fate and a retry draws the
    same. Documents without words weigh nothing and get the probability of their cell. Without ``targets``, each dimension
    is flattened by ``power``. With ``budget``, that share of all tokens is drawn in expectation, or all that the targets admit if
    that is less; cells too rare for their targets are kept whole. All columns stay, but for those that have the names of the results; a given column "topic"
    can be passed as ``topic``. An empty table gives an empty result.
    """
    label = topic if topic is not None else topic_bucket(F.col(f"`{text_col}`"))
    inner, names = shielded(docs.withColumn("given topic", label))
    text = F.col(names[text_col])
    marked = inner.withColumns({
        "_source": F.coalesce(F.col(names["source"]).cast("string"), F.lit(NONE)),
        "_lang": F.coalesce(F.col(names["lang"]).cast("string"), F.lit(NONE)),
        "_topic": F.coalesce(F.col(names.pop("given topic")).cast("string"), F.lit(NONE)), "_tokens": count_words(text),
    })
    inside = {d: f"_{d}" for d in DIMENSIONS}
    cells = written(
        marked.groupBy(*[F.col(c).alias(d) for d, c in inside.items()]).agg(F.sum("_tokens").alias("tokens")), "cells")
    wanted = targets or {d: written(flattened(cells, d, power), "targets") for d in DIMENSIONS}
    raked, _ = rake(cells, wanted)
    if budget is None:
        largest = raked.agg(F.max(F.when(F.col("tokens") > 0, F.col("factor"))).alias("largest"))
        scaled = raked.join(largest).withColumn("scaled", F.coalesce(F.try_divide("factor", "largest"), F.lit(0.0)))
    else:
        scale = scale_for(raked, budget)
        kept_whole = F.when(F.col("factor") > 0, 1.0).otherwise(0.0)
        scaled = raked.withColumn("scaled", kept_whole if scale == math.inf else F.col("factor") * scale)
    chances = written(
        scaled.select(*[F.col(d).alias(c) for d, c in inside.items()], F.least("scaled", F.lit(1.0)).alias("_probability")), "chances")
    draw = F.pmod(F.xxhash64(*[F.col(names[k]) for k in key_cols], text, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    return unshielded(marked.join(chances, list(inside.values())), names, {
        "topic": F.col("_topic"), "tokens": F.col("_tokens"), "probability": F.col("_probability"),
        "drawn": draw < F.col("_probability")})
