"""Exact dedup: 128-bit content hash, smallest stable id, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import RID, P, materialise, table, with_row_ids
from cladewise.sources.shared import by_shuffle

H, KEEP, LEAD, N = P + "h", P + "keep", P + "lead", P + "n"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """Find equal texts; one row per input row: ``doc_id, keep_id, group_size, kept, text_sha256`` and the row's number.

    Texts are grouped by the 128-bit ``content_hash`` of the normalised text.
    In each group the row with the smallest id leads (null ids last, then the
    row number decides, so repeated rows leave exactly one). The texts of
    groups of two and more are then compared with their leader's text, so a
    collision of the hash never joins different texts: rows that differ from
    their leader form a new round. Nulls count as empty texts, which are equal
    to each other. Extra columns are ignored; an empty table gives no rows.
    ``row_id`` names a stored unique row number; without it one is made here.
    """
    rid = F.col(row_id) if row_id else F.monotonically_increasing_id()
    norm = P + "norm"
    texts = docs.select(F.col(id_col).alias("id"), rid.alias(RID), normalised(F.col(text_col)).alias(norm))
    rows = materialise(texts.select("id", RID, content_hash(F.col(norm)).alias(H), F.sha2(norm, 256).alias("sha")))
    lead = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col(RID).alias("rid")))
    groups = materialise(rows.groupBy(H).agg(lead.alias(LEAD), F.count(F.lit(1)).alias(N)))
    # Spark takes hashes in text for a few bytes each, and nearly every row has one here
    single = rows.join(by_shuffle(groups.where(F.col(N) == 1).select(H)), H, "left_semi")
    single = single.select(F.col("id").alias("doc_id"), F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"), RID)

    # Rows whose hash another row has: compare bytes with the leader, round by round until no row differs.
    several = groups.where(F.col(N) > 1).select(H, LEAD)
    done = None
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), *([F.col(row_id).alias(RID)] if row_id else []))
    members = source.select("id", *([RID] if row_id else []), normalised(F.col("t")).alias(norm)).withColumn(H, content_hash(F.col(norm)))
    members = members.join(several.select(H), H, "left_semi")
    if not row_id:
        # equal (id, hash, text) rows are alike: number them anew and take the stored numbers in the same order
        members = members.withColumn(RID, F.monotonically_increasing_id())
    members = materialise(members.withColumn("sha", F.sha2(norm, 256)))
    if not row_id:
        several = members.groupBy(H).agg(lead.alias(LEAD))
    while True:
        leads = materialise(several.select(F.col(LEAD)["rid"].alias("leader"), F.col(LEAD)["id"].alias("keep_id"), H))
        leaders = members.join(leads, members[RID] == leads["leader"]).select(leads["leader"], leads["keep_id"], members[H].alias("lh"), members[norm].alias("lt"))
        pairs = members.join(leaders, F.col(H) == F.col("lh"))
        judged = materialise(pairs.select("id", RID, H, "sha", "keep_id", "leader", (F.col(norm) == F.col("lt")).alias("same")))
        same = judged.where("same").drop("same")
        done = same if done is None else done.unionByName(same)
        differ = judged.where("NOT same")
        if differ.isEmpty():
            break
        members = materialise(members.join(differ.select(RID), RID, "left_semi"))
        several = members.groupBy(H).agg(lead.alias(LEAD))
    sizes = done.groupBy("leader").agg(F.count(F.lit(1)).alias("group_size"))
    found = done.join(sizes, "leader").select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col(RID) == F.col("leader")).alias("kept"), F.col("sha").alias("text_sha256"), RID)
    return single.unionByName(found)


def drop_exact_copies(docs: DataFrame, **columns: str) -> DataFrame:
    """The rows of ``docs`` that stay, with the columns of ``docs``."""
    held = with_row_ids(docs)
    stay = exact_dedup(held, row_id=RID, **columns).where("kept").select(RID)
    return held.join(stay, RID, "left_semi").select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop(RID)


OP6_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
