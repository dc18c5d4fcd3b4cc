"""Rejection sampling under envelopes that rise where a proposal exceeds them, over stored proposals.

``proposals(ds, draw, shell, lw, pilot)``: draws have unique numbers in a data
set, pilots the smallest; ``lw`` is the log of target over proposal density.
Null or not finite log weights take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cladewise.functions import scalars as S
from cladewise.operators.sampling import STRETCH, envelopes
from cladewise.sources.shared import stored


def pilot_bounds(pilots: DataFrame, shells: int) -> DataFrame:
    """``ds, shell, bound, spread`` of all shells from the pilots; one without pilots takes the numbers of the next shell inside, or else outside."""
    known = envelopes(pilots, 0.990, 0.999, margin=(0.35, 0.60))
    every = pilots.select("ds").distinct().withColumn("shell", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shells - 1).cast("long")))).join(known, ["ds", "shell"], "left")
    inside, outside = (Window.partitionBy("ds").orderBy(o) for o in (F.asc("shell"), F.desc("shell")))
    fill = lambda c: F.coalesce(F.last(c, True).over(inside), F.last(c, True).over(outside)).alias(c)
    return every.select("ds", "shell", fill("bound"), fill("spread"))


def raises(proposals: DataFrame, bounds: DataFrame, least: float = 0.25, gain: float = 1.05, growth: float = 1.6) -> DataFrame:
    """``ds, shell, at, bound``: the draws that exceed their shell's bound at their turn, and the bound from then on.

    A bound rises above what exceeds it by the greatest of ``least``, twice the
    shell's spread and ``gain`` times the gap, and by ``growth`` more at each
    further time. A round finds the next such draw of all shells at once; only
    proposals above the first bounds are looked at again.
    """
    above = stored(proposals.where("NOT pilot").join(bounds, ["ds", "shell"]).where("lw > bound").select("ds", "shell", "draw", "lw"))
    now = stored(bounds.select("ds", "shell", F.lit(None).cast("long").alias("at"), "bound", "spread", F.lit(0).alias("n")))
    found = []
    while not now.isEmpty():
        later = above.join(now, ["ds", "shell"]).where((F.col("at").isNull() | (F.col("draw") > F.col("at"))) & (F.col("lw") > F.col("bound")))
        first = later.groupBy("ds", "shell", "bound", "spread", "n").agg(F.min(F.struct("draw", "lw")).alias("v"))
        bump = F.greatest(F.lit(least), 2.0 * F.col("spread"), gain * (F.col("v.lw") - F.col("bound"))) * F.pow(F.lit(growth), F.col("n"))
        now = stored(first.select("ds", "shell", F.col("v.draw").alias("at"), (F.col("v.lw") + bump).alias("bound"), "spread", (F.col("n") + 1).alias("n")))
        found.append(now.select("ds", "shell", "at", "bound"))
    return reduce(DataFrame.unionByName, found) if found else now.select("ds", "shell", "at", "bound")


def reach(steps: DataFrame, n: int, stretch: int = STRETCH) -> DataFrame:
    """``ds, stop``: the first ``at`` at which the running sum of ``steps(ds, at, step)`` is ``n``; data sets that get there only. Sums run within stretches, on top of the sums of those before."""
    cut = steps.withColumn("part", F.floor(F.col("at") / stretch))
    before = Window.partitionBy("ds").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cut.groupBy("ds", "part").agg(F.sum("step").alias("s")).select("ds", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    run = F.col("before") + F.sum("step").over(Window.partitionBy("ds", "part").orderBy("at", "step"))
    return cut.join(parts, ["ds", "part"]).withColumn("run", run).where(F.col("run") >= n).groupBy("ds").agg(F.min("at").alias("stop"))


def sample(proposals: DataFrame, n: int, shells: int = 12, floor: float = 0.001, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The accepted draws ``ds, draw, place`` and each data set's ``ds, state, accepted, raised, rate``.

    A draw is accepted if the log of its uniform number is at most its log
    weight less its shell's bound. One that exceeds the bound is thrown away and
    raises it (:func:`raises`); what its shell had accepted before is judged again
    by the new bound. Sampling stops at the first draw after which ``n`` are
    accepted; pilots are judged first, under the bounds they gave. ``state``: ``done``;
    ``short`` if the proposals end before; ``refused``, without draws, if the
    share of pilots accepted is below ``floor`` (``rate``: up to the ``n``-th). An empty
    table gives no rows; a data set without pilots is not sampled.
    """
    clean = proposals.select("ds", "draw", "shell", "lw", "pilot").where("lw IS NOT NULL AND NOT isnan(lw) AND abs(lw) < double('infinity')")
    ready = stored(clean.withColumn("lu", F.log(S.uniform(F.lit(seed), F.col("ds"), F.col("draw")))))
    bounds = stored(pilot_bounds(ready.where("pilot"), shells))
    up = stored(raises(ready, bounds))
    spans = bounds.select("ds", "shell", F.lit(None).cast("long").alias("at"), "bound").unionByName(up)
    spans = spans.withColumn("until", F.lead("at").over(Window.partitionBy("ds", "shell").orderBy(F.asc_nulls_first("at"))))
    judged = ready.join(spans, ["ds", "shell"]).where("(at IS NULL OR draw > at) AND (until IS NULL OR draw <= until) AND lu <= lw - bound AND (pilot OR lw <= bound)").select("ds", "shell", "draw", "lw", "lu", "pilot")
    lost = judged.join(up, ["ds", "shell"]).where("at > draw AND lu > lw - bound").groupBy("ds", "draw").agg(F.min("at").alias("end"))
    taken = stored(judged.join(lost, ["ds", "draw"], "left").select("ds", "draw", "end", "pilot"))
    steps = taken.select("ds", F.col("draw").alias("at"), F.lit(1).alias("step")).unionByName(taken.where("end IS NOT NULL").select("ds", F.col("end").alias("at"), F.lit(-1).alias("step")))
    stop = reach(steps, n)
    full = reach(taken.where("pilot").select("ds", F.col("draw").alias("at"), F.lit(1).alias("step")), n)
    seen = ready.where("pilot").join(full, "ds", "left").where("stop IS NULL OR draw <= stop").groupBy("ds").agg(F.count(F.lit(1)).alias("seen"))
    won = taken.where("pilot").groupBy("ds").agg(F.count(F.lit(1)).alias("won"))
    rate = seen.join(won, "ds", "left").select("ds", (F.least(F.coalesce("won", F.lit(0)), F.lit(n)) / F.col("seen")).alias("rate"))
    known = stored(rate.join(stop, "ds", "left"))
    out = taken.join(known.where(F.col("rate") >= floor), "ds").where("stop IS NULL OR (draw <= stop AND (end IS NULL OR end > stop))").where("stop IS NOT NULL OR end IS NULL")
    draws = stored(out.select("ds", "draw", F.row_number().over(Window.partitionBy("ds").orderBy("draw")).alias("place")))
    risen = up.join(known, "ds").where("stop IS NULL OR at <= stop").groupBy("ds").agg(F.count(F.lit(1)).alias("raised"))
    state = F.when(F.col("rate") < floor, "refused").when(F.col("stop").isNull(), "short").otherwise("done")
    count = draws.groupBy("ds").agg(F.count(F.lit(1)).alias("accepted"))
    report = known.join(count, "ds", "left").join(risen, "ds", "left").select("ds", state.alias("state"), F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("raised", F.lit(0)).alias("raised"), "rate")
    return draws, report
