"""Exact top-k search by inner product over a bit-sliced index.

A block of vectors is kept as bitmaps: one for each dimension and bit, with a
bit for each vector. A query's score is the sum of its components times the
attributes; the components' signed binary digits choose which slices are added
at which weight, and carry-save adders made of bitmap arithmetic add them. The
slices of the sum, from the most significant downward, then select the top
rows; rows equal to the last one are resolved by id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.llm.common import RID, materialise, table

BLOCK, QUERY_BLOCK, PASS, K = 1 << 14, 256, 1 << 16, 20
_LIMIT = 1 << 50


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled with zeros, which add nothing to an inner product."""
    v = vectors.combine_chunks()
    lengths = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lengths), max(1, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Slices ``(dimension, complement or not, bit, word)`` of the integer matrix ``x`` (rows, dimensions) and the offset that was added to every value."""
    low = int(x.min(initial=0))
    bits = max(1, (int(x.max(initial=0)) - low).bit_length())
    words = -(-len(x) // 64)
    shifted = np.zeros((x.shape[1], words * 64), np.int64)
    shifted[:, : len(x)] = (x - low).T
    slices = np.empty((x.shape[1], 2, bits, words), np.uint64)
    for bit in range(bits):
        slices[:, 0, bit] = np.packbits((shifted >> bit & 1).astype(np.uint8), axis=1, bitorder="little").view("<u8")
    np.invert(slices[:, 0], out=slices[:, 1])
    return slices, -low


def _digits(n: int) -> list[tuple[int, int]]:
    """Non-adjacent form of ``n``: (weight, sign) of each digit that is not 0."""
    out, at = [], 0
    while n:
        if n & 1:
            sign = 2 - (n & 3)
            out.append((at, sign))
            n -= sign
        n >>= 1
        at += 1
    return out


def weighted_sum(slices: np.ndarray, offset: int, query: np.ndarray) -> tuple[list[np.ndarray], int]:
    """Slices of ``score + constant`` for all rows of a block, least significant first, and the constant."""
    dims, _, bits, words = slices.shape
    flat = slices.reshape(-1, words)
    at_weight: dict[int, list[int]] = {}
    constant = 0
    for d, q in enumerate(query[:dims].tolist()):
        constant += offset * q
        for weight, sign in _digits(q):
            base = (2 * d + (sign < 0)) * bits
            if sign < 0:
                constant += ((1 << bits) - 1) << weight
            for bit in range(bits):
                at_weight.setdefault(weight + bit, []).append(base + bit)
    total: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    weight, top = 0, max(at_weight, default=-1)
    while weight <= top or carried:
        parts = carried
        if weight in at_weight:
            parts = [flat[at_weight[weight]], *carried]
        a = np.concatenate(parts) if len(parts) > 1 else parts[0] if parts else np.zeros((1, words), np.uint64)
        carried = []
        while len(a) > 2:  # full adders: three bitmaps of a weight make one of it and one of the next
            n = len(a) // 3
            x, y, z = a[:n], a[n : 2 * n], a[2 * n : 3 * n]
            u = x ^ y
            carry = u & z
            x = x & y
            carry |= x
            u ^= z
            carried.append(carry)
            a = np.concatenate([u, a[3 * n :]]) if len(a) % 3 else u
        if len(a) == 2:
            carried.append(a[:1] & a[1:])
            a = a[:1] ^ a[1:]
        total.append(a[0])
        weight += 1
    return total, constant


def select(total: list[np.ndarray], rows: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` greatest sums among the bitmap ``rows``; ties go to the smaller position."""
    sure, equal, have = np.zeros_like(rows), rows.copy(), 0
    for s in reversed(total):
        hit = equal & s
        n = int(np.bitwise_count(hit).sum())
        if have + n > k:
            equal = hit
        else:
            sure |= hit
            have += n
            equal &= ~s
            if have == k:
                equal[:] = 0
                break
    at = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return np.concatenate([at(sure), at(equal)[: k - have]])


def top_k(embeddings: DataFrame, k: int = K, every: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """Top ``k`` of each query: ``query_id, rank, vec_id, score``.

    Components become ``floor(scale * x)``. Queries are the rows whose id is
    divisible by ``every``; candidates all rows but the query's own (a repeated
    row is a candidate for its copy, and repeated queries are answered each).
    Ties go to the smaller id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows without an id. Vectors of unequal
    lengths are compared over their common prefix. Values beyond 2**50 are
    clamped, scores beyond a long too. Extra columns are ignored; an empty table
    gives no rows. A block of the index holds about ``block`` rows and stays
    where it is for a pass of ``PASS`` queries, whose blocks come to it one
    after the other.
    """
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = F.transform(x, lambda e: F.greatest(F.lit(-_LIMIT), F.least(F.lit(_LIMIT), F.floor(e.cast("double") * scale))).cast("long"))
    rows = materialise(embeddings.where(F.col(id_col).isNotNull() & usable).select(F.col(id_col).cast("long").alias("vec_id"), F.monotonically_increasing_id().alias(RID), scaled.alias("v")))
    queries = rows.where(F.col("vec_id") % every == 0)
    n_blocks, n_queries = max(1, -(-rows.count() // block)), max(1, -(-queries.count() // QUERY_BLOCK))

    def index(group: pa.Table) -> pa.Table:
        group = group.sort_by([("vec_id", "ascending"), (RID, "ascending")])
        slices, offset = build(_matrix(group["v"]))
        packed = [group["b"][0].as_py(), group["vec_id"].to_numpy().tobytes(), group[RID].to_numpy().tobytes(), slices[:, 0].tobytes(), list(slices.shape), offset]
        return pa.Table.from_arrays([pa.array([p], t) for p, t in zip(packed, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64()))], names=["b", "ids", "rids", "slices", "shape", "off"])

    def gather(group: pa.Table) -> pa.Table:
        q = _matrix(group["v"])
        packed = [group["q"][0].as_py(), group["vec_id"].to_numpy().tobytes(), group[RID].to_numpy().tobytes(), q.tobytes(), q.shape[1]]
        return pa.Table.from_arrays([pa.array([p], t) for p, t in zip(packed, (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))], names=["q", "qids", "qrids", "queries", "dims"])

    def search(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids, rids = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rids"], np.int64)
                dims, _, bits, words = r["shape"]
                slices = np.empty((dims, 2, bits, words), np.uint64)
                slices[:, 0] = np.frombuffer(r["slices"], np.uint64).reshape(dims, bits, words)
                np.invert(slices[:, 0], out=slices[:, 1])
                whole = np.packbits(np.arange(64 * words) < len(ids), bitorder="little").view("<u8")
                place = {rid: i for i, rid in enumerate(rids.tolist())}
                found: list[list] = [[], [], [], []]
                qids, qrids = np.frombuffer(r["qids"], np.int64), np.frombuffer(r["qrids"], np.int64)
                for qid, qrid, q in zip(qids.tolist(), qrids.tolist(), np.frombuffer(r["queries"], np.int64).reshape(-1, r["dims"])):
                    total, constant = weighted_sum(slices, r["off"], q)
                    valid = whole.copy()
                    if (own := place.get(qrid)) is not None:
                        valid[own // 64] &= ~np.uint64(1 << own % 64)
                    at = select(total, valid, k)
                    bit = [(s[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1)).tolist() for s in total]
                    found[0] += [qid] * len(at)
                    found[1] += [qrid] * len(at)
                    found[2] += at.tolist()
                    found[3] += [max(-(1 << 63), min((1 << 63) - 1, sum(b[i] << w for w, b in enumerate(bit)) - constant)) for i in range(len(at))]
                place_of = np.array(found[2], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(ids[place_of]), pa.array(rids[place_of]), pa.array(found[3], pa.int64())], names=["query_id", "qrid", "vec_id", "rid", "score"])

    blocks = rows.withColumn("b", F.pmod(F.xxhash64(RID), F.lit(n_blocks))).groupBy("b").applyInArrow(index, "b long, ids binary, rids binary, slices binary, shape array<long>, off long")
    asked = queries.withColumn("q", F.pmod(F.xxhash64(F.lit(1), RID), F.lit(n_queries))).groupBy("q").applyInArrow(gather, "q long, qids binary, qrids binary, queries binary, dims long")
    # the small blocks of queries travel to every block of the index, which travels once for each pass
    a_pass = max(1, PASS // QUERY_BLOCK)
    passes = -(-n_queries // a_pass)
    left = materialise(blocks).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)).cast("array<long>")))
    right = materialise(asked).withColumn("pass", F.floor(F.col("q") / a_pass)).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")))
    pairs = right.join(left.hint("shuffle_hash"), ["b", "pass"])
    found = pairs.mapInArrow(search, "query_id long, qrid long, vec_id long, rid long, score long")
    rank = F.row_number().over(Window.partitionBy("qrid").orderBy(F.desc("score"), "vec_id", "rid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
