"""SimHash near-dedup with pigeonring filtering.

Fingerprints of 64 bits are cut into four segments on a ring. If two differ in
at most three bits, some segment starts a chain whose first l segments differ
in at most floor(3 l / 4) bits for every l: 0, 1, 2, 3. The first two demands
make an equality join (the first segment equal, the second equal or one bit
off), the third is tested in that join's condition, and only what is left gets
the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import RID, P, few_rows, materialise, table, with_row_ids
from cladewise.llm.components import components
from cladewise.sources.shared import by_shuffle

BITS, SEGMENTS = 64, 4
WIDTH = BITS // SEGMENTS
_BLOCK = 1 << 16
ROOT = P + "root"


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text``; 0 for null and for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    size = min(shingle, len(words))
    n = len(words) - size + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _BLOCK):
        parts = [words[at + i : min(at + i + _BLOCK, n + i)] for i in range(size)]
        hashes = np.array([digest(b" ".join(s), 42) for s in zip(*parts)], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, row_id: str | None, shingle: int) -> DataFrame:
    """``id, RID, fp`` (fp: the 64 bits as a signed long)."""
    rid = F.col(row_id).cast("long") if row_id else F.lit(None).cast("long")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            found = np.array([fingerprint(t, shingle) for t in b.column("t").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column(RID), pa.array(found)], names=["id", RID, "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), rid.alias(RID), F.col(text_col).alias("t")).mapInArrow(each, f"id long, {RID} long, fp long")


def _segment(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, WIDTH * (i % SEGMENTS)).bitwiseAND(F.lit((1 << WIDTH) - 1))


def links(distinct: DataFrame, within: int = 3) -> DataFrame:
    """Pairs ``a < b`` of ``distinct(fp)`` that differ in at most ``within`` (3 at most) bits, each once."""
    fp = F.col("fp")
    # The key of a chain holds its start, its first segment, and the second one.
    base = [F.lit(i << 32).bitwiseOR(F.shiftleft(_segment(fp, i), WIDTH)).bitwiseOR(_segment(fp, i + 1)) for i in range(SEGMENTS)]
    # A pair that is one bit off in the second segment meets once: at the fingerprint with the 0 there.
    flips = [F.when(key.bitwiseAND(F.lit(1 << bit)) == 0, key.bitwiseOR(F.lit(1 << bit))) for key in base for bit in range(WIDTH)]
    left = distinct.select(fp.alias("a"), F.explode(F.array(*base)).alias("key")).withColumn("turn", (F.shiftright("key", 32) * WIDTH).cast("int"))
    exact = [F.struct(key.alias("key"), F.lit(False).alias("off")) for key in base]
    near = [F.struct(key.alias("key"), F.lit(True).alias("off")) for key in flips]
    right = distinct.select(fp.alias("b"), F.explode(F.array(*exact, *near)).alias("v")).select("b", F.col("v.key").alias("other"), "v.off").where("other IS NOT NULL")
    chain = f"bit_count(((shiftrightunsigned(a ^ b, turn)) | (CASE WHEN turn = 0 THEN 0 ELSE shiftleft(a ^ b, {BITS} - turn) END)) & {(1 << 3 * WIDTH) - 1}L) <= {3 * within // SEGMENTS}"
    # Spark sizes an exploded side by the fingerprints, not by its 36 rows of each on average, so it would take it for small.
    met = left.join(by_shuffle(right), F.expr(f"key = other AND (off OR a < b) AND {chain} AND bit_count(a ^ b) <= {within}"))
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None, shingle: int = 3, within: int = 3) -> DataFrame:
    """One row per document: ``doc_id, fingerprint, component_id, n_links`` and its row number (null without ``row_id``).

    Documents whose fingerprints differ in at most ``within`` bits are linked;
    ``component_id`` is the smallest id reachable over links (nulls do not
    count; a component with null ids only gets null). ``n_links`` counts the
    other distinct fingerprints linked to the document's. Null, empty and
    blank texts have fingerprint 0 and are linked like any other. Copies share
    a fingerprint, and only distinct fingerprints are compared. Extra columns
    are ignored; an empty table gives no rows.
    """
    if not 0 <= within < SEGMENTS:
        raise ValueError("within must lie between 0 and 3")
    rows = materialise(fingerprints(docs, id_col, text_col, row_id, shingle))
    distinct = materialise(rows.groupBy("fp").agg(F.min("id").alias("first")))
    found = materialise(links(distinct.select("fp"), within))
    roots = components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_links"))
    placed = materialise(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")).join(degree, "fp", "left"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialise(placed.join(smallest, "root").select("fp", F.col("root").alias(ROOT), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")))
    return rows.join(label, "fp").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links", RID, ROOT
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """One row of each component stays: that with the smallest id, then the smallest row number; columns as in ``docs``."""
    held = with_row_ids(docs)
    found = materialise(near_duplicates(held, id_col=id_col, row_id=RID, **options).select("doc_id", ROOT, RID))
    stay = found.groupBy(ROOT).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", RID))[RID].alias(RID))
    return held.join(stay.select(RID), RID, "left_semi").select(*docs.columns)


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop(RID, ROOT)
