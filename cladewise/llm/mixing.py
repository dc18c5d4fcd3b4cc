"""Mixing sources to target weights by Pareto order sampling.

Every document gets an expected number of copies. Its whole part is certain;
the rest is its inclusion odds for one more copy. Within a source documents are
ranked by random odds over inclusion odds, and the first ones are taken until
the words of the source meet its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.llm.common import RID, P, materialise, number_rows, table, with_row_ids

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2.0, 20_240_601
S = P + "source"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Add ``number`` and ``target`` to ``sizes(source, source_size)``, one row per source.

    Sources by code point, null last, take ``weights`` in turn and share
    ``share`` times all words; no target is above ``cap`` times its source's
    size, and what is cut off goes to the others by weight.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    named = number_rows(sizes, [F.col(S).asc_nulls_last()], "number")
    named = materialise(named.withColumn("weight", F.get(cycle, (F.col("number") % len(weights)).cast("int"))).withColumn("most", cap * F.col("source_size")))
    total = named.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # every pass caps at least one more source; the level only rises
        capped = F.col("most") <= level * F.col("weight")
        used, weight = named.agg(F.sum(F.when(capped, F.col("most"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not weight:
            level = float("inf")
            break
        raised = (share * total - (used or 0.0)) / weight
        if raised <= level:
            break
        level = raised
    return named.withColumn("target", F.least("most", F.lit(level) * F.col("weight")))


def _expected(levels: DataFrame, cap: float) -> DataFrame:
    """Copies expected of a document by source and weight level: ``min(cap, c * weight)`` with c so that the source meets its target."""
    down = Window.partitionBy("number").orderBy(F.desc("doc_weight"))
    up = down.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.partitionBy("number").orderBy("doc_weight").rowsBetween(Window.unboundedPreceding, 0)
    # c if all levels above this one are capped and this one and those below are not
    at = levels.withColumn("above", F.coalesce(F.sum("words").over(up), F.lit(0))).withColumn("below", F.sum(F.col("doc_weight") * F.col("words")).over(rest))
    c = F.try_divide(F.col("target") - cap * F.col("above"), F.col("below"))
    right = at.withColumn("c", c).groupBy("number").agg(F.min_by("c", F.when(F.col("c") * F.col("doc_weight") <= cap, -F.col("doc_weight"))).alias("c"))
    return levels.join(right, "number").withColumn("copies", F.when(F.col("c").isNull(), cap).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(cap), F.col("c") * F.col("doc_weight")))))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_id: str | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document.

    One row per input row: ``doc_id, size, source_size, target, taken`` (words),
    ``copies``, ``expected_copies`` and the row's number. The words taken of a
    source differ from its target by at most half the one document that crosses
    it. Longer documents are likelier: the weight of a document is the bit
    length of its size. The random numbers depend on seed, id and text, so
    reruns agree. Texts without words (null, empty, blank) have size 0 and add
    nothing to a mix: 0 copies. A null source is a source; its turn is the last. Equal ranks are
    ordered by id and row number. An empty table gives no rows; other columns
    are ignored.
    """
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    picked = docs.select(F.col(id_col).alias("doc_id"), rid.alias(RID), F.col(source_col).alias(S), words(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"))
    u = (F.shiftrightunsigned("h", 12).cast("double") + 0.5) / float(1 << 52)
    weight = F.when(F.col("size") == 0, 1.0).otherwise(F.length(F.bin("size")).cast("double"))
    rows = materialise(picked.withColumn("doc_weight", weight).withColumn("odds", u / (1 - u)).drop("h"))
    by_level = materialise(rows.groupBy(S, "doc_weight").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")))
    sources = source_targets(by_level.groupBy(S).agg(F.sum("words").alias("source_size")), weights, share, cap)
    levels = by_level.join(sources, by_level[S].eqNullSafe(sources[S])).select(by_level[S], "number", "source_size", "target", "doc_weight", "words", "n")
    plan = materialise(_expected(levels, cap).withColumn("certain", F.floor(F.col("copies") + 1e-9)).withColumn("p", F.greatest(F.lit(0.0), F.col("copies") - F.col("certain"))))
    need = plan.groupBy("number").agg((F.first("target") - F.sum(F.col("certain") * F.col("words"))).alias("need"))
    n = plan.agg(F.sum("n")).first()[0] or 0
    buckets = 1 << (max(1, n) - 1).bit_length() // 2  # about sqrt(n): neither the buckets of a source nor the rows of a bucket are many

    one = plan.select(F.col(S).alias("s"), F.col("doc_weight").alias("w"), "number", "source_size", "target", "copies", "certain", "p")
    ranked = rows.join(one, rows[S].eqNullSafe(one["s"]) & (rows["doc_weight"] == one["w"]))
    open_ = (F.col("p") > 1e-9) & (F.col("size") > 0)
    rank = F.when(open_, F.col("odds") * (1 - F.col("p")) / F.col("p"))
    # q / (1 + q) keeps the order of the ranks q and lies between 0 and 1
    ranked = ranked.withColumn("rank", rank).withColumn("bucket", F.when(F.col("rank").isNotNull(), F.least(F.lit(buckets - 1), F.floor(buckets * F.col("rank") / (1 + F.col("rank"))))).cast("int"))
    filled = materialise(ranked.where("rank IS NOT NULL").groupBy("number", "bucket").agg(F.sum("size").alias("words")))
    run = F.sum("words").over(Window.partitionBy("number").orderBy("bucket"))
    edge = filled.withColumn("upto", run).join(need, "number").where("upto > need").groupBy("number").agg(F.min(F.struct("bucket", (F.col("need") - F.col("upto") + F.col("words")).alias("left"))).alias("e"))
    edge = materialise(edge.select("number", F.col("e.bucket").alias("edge"), F.col("e.left").alias("left")))
    ranked = ranked.join(edge, "number", "left")
    # no edge: the candidates of the source are all needed
    whole = ranked.where("rank IS NULL OR edge IS NULL OR bucket <> edge").withColumn("extra", F.expr("rank IS NOT NULL AND (edge IS NULL OR bucket < edge)").cast("int"))
    after = F.sum("size").over(Window.partitionBy("number").orderBy("rank", "doc_id", RID).rowsBetween(Window.unboundedPreceding, 0))
    last = ranked.where("bucket = edge").withColumn("after", after).withColumn("extra", F.expr("after <= left OR (after - size < left AND after - left < left - (after - size))").cast("int")).drop("after")
    return whole.unionByName(last).select(
        "doc_id", "size", "source_size", "target", ((F.col("certain") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
        F.when(F.col("size") > 0, F.col("certain") + F.col("extra")).otherwise(0).cast("int").alias("copies"), F.col("copies").alias("expected_copies"), RID,
    )


def apply_mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    held = with_row_ids(docs)
    taken = mix(held, row_id=RID, **options).where("copies > 0").select(F.col(RID).alias(P + "r"), F.col("copies").alias(P + "c"))
    return held.join(taken, held[RID] == taken[P + "r"]).withColumn(P + "i", F.explode(F.sequence(F.lit(1), F.col(P + "c")))).select(*docs.columns)


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop(RID)
