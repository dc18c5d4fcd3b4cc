"""Sharding by balanced label propagation.

Documents with equal texts are linked through their group, so a group of n
copies has n links and not n^2. Each round every group votes for the shard that
holds most of it, and its other members ask to move there; a shard admits them
as far as its quota goes, until none asks or rounds no longer help. Large groups
are placed whole before that; only one that exceeds the room of every shard is
cut. At the end the shards are evened out exactly, by moving documents without
links first.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import RID, P, materialise, number_rows, table

SHARDS, PATIENCE, SEED = 8, 3, 77
_OPEN_AFTER = 2  # from this round on votes pass over full shards
_LARGE = 64  # groups of more than a shard's size divided by this are placed first: no more than this many a shard


def _loads(rows: DataFrame, shards: int) -> list[int]:
    found = dict(rows.groupBy("shard").count().collect())  # one row for each shard
    return [found.get(s, 0) for s in range(shards)]


def place(sizes: dict[str, int], room: list[int]) -> list[tuple[str, int, int, int]]:
    """Places ``(group, first, end, shard)`` of groups' rows, the largest group first: whole where one shard has room (the least that does), else as much as the emptiest shard holds, and the rest again. Takes from ``room``."""
    out = []
    left = [(-n, g, 0) for g, n in sizes.items()]
    heapq.heapify(left)
    while left:
        n, g, first = heapq.heappop(left)
        fits = [s for s in range(len(room)) if room[s] >= -n]
        s = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
        taken = min(-n, room[s])
        room[s] -= taken
        out.append((g, first, first + taken, s))
        if taken < -n:
            heapq.heappush(left, (n + taken, g, first + taken))
    return out


def propagate(linked: DataFrame, shards: int, capacity: list[int], patience: int = PATIENCE, seed: int = SEED) -> DataFrame:
    """Move members of ``linked(RID, grp, shard)`` towards the shard where most of their group is, within each shard's ``capacity``, until no group asks or ``patience`` rounds in a row leave no fewer rows asking."""
    least, idle = None, 0
    for r in itertools.count():
        load = _loads(linked, shards)
        full = [s for s in range(shards) if r >= _OPEN_AFTER and load[s] >= capacity[s]]
        tally = materialise(linked.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n")))
        weight = F.when(F.col("shard").isin(full), 0).otherwise(F.col("n")) if full else F.col("n")
        vote = tally.groupBy("grp").agg(F.max_by("shard", F.struct(weight, F.xxhash64(F.lit(seed), "grp", "shard"))).alias("to"))
        # a mover gains as many links as its group has in the target, and loses those at home: groups ask as a whole
        asks = materialise(tally.join(vote, "grp").where("shard <> to").groupBy("grp", "to").agg(F.sum("n").alias("movers")))
        demand = dict(asks.groupBy("to").agg(F.sum("movers")).collect())  # one row for each shard
        asking = sum(demand.values())
        idle = 0 if least is None or asking < least or r <= _OPEN_AFTER else idle + 1
        least = asking if least is None or r <= _OPEN_AFTER else min(least, asking)
        if not demand or idle >= patience:
            break
        leaving = dict(asks.join(tally, "grp").where("shard <> to").groupBy("shard").agg(F.sum("n")).collect())
        # what leaves a shard makes room there, as far as it is sure to be admitted elsewhere; half of it is counted on
        room = {s: max(0, capacity[s] - load[s] + leaving.get(s, 0) // 2) for s in range(shards)}
        part = F.coalesce(*[F.when(F.col("to") == s, min(1.0, room[s] / demand[s])) for s in demand], F.lit(0.0))
        draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + r), "grp"), 12).cast("double")) / float(1 << 52)
        admitted = asks.where(draw < part).select("grp", "to")
        linked = materialise(linked.join(admitted, "grp", "left").select(RID, "grp", F.coalesce("to", "shard").alias("shard")))
    return linked


def _even(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Give ``rows(shard, loose, ...)`` new shards of equal row counts, one apart at most, and slots; rows above a shard's count move, loose ones first."""
    placed = number_rows(rows, [F.asc("shard"), F.asc("loose"), F.asc("grp"), F.asc("doc_id"), F.asc("h"), F.asc(RID)], P + "n")
    placed = materialise(placed)
    load = _loads(placed, shards)
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    first = [sum(load[:s]) for s in range(shards)]
    pick = lambda values: F.coalesce(*[F.when(F.col("shard") == s, F.lit(v)) for s, v in enumerate(values)])
    inside = F.col(P + "n") - pick(first)
    stay = placed.withColumn("slot", inside).where(F.col("slot") < pick(quota))
    # the surplus, numbered on over all shards, fills the free slots of the others in turn
    surplus = [max(0, load[s] - quota[s]) for s in range(shards)]
    free = [max(0, quota[s] - load[s]) for s in range(shards)]
    number = inside - pick(quota) + pick([sum(surplus[:s]) for s in range(shards)])
    over = placed.withColumn("k", number).where(inside >= pick(quota))
    into = F.coalesce(*[F.when(F.col("k") < sum(free[: s + 1]), F.lit(s)) for s in range(shards)])
    over = over.withColumn("to", into)
    slot = F.coalesce(*[F.when(F.col("to") == s, F.col("k") - sum(free[:s]) + min(load[s], quota[s])) for s in range(shards)])
    moved = over.withColumn("slot", slot).withColumn("shard", F.col("to")).drop("k", "to")
    return stay.unionByName(moved).drop(P + "n")


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, patience: int = PATIENCE, seed: int = SEED) -> DataFrame:
    """Put every row into one of ``shards`` shards under the law ``rows``: counts differ by one at most.

    One row per input row: ``doc_id, size, text_crc32, law, shard, slot,
    grown_shard`` and ``group_size``. Rows with equal texts are links to keep
    in one shard; only a group for which no shard has room is split, into as few
    parts as hold it. Texts are told apart by
    128 bits of hash and their length, so a long text costs no more than its
    scan. Null texts count as empty: size 1, CRC 0. Ids and texts decide, so
    other files or partitions give the same shards, but for which of the rows
    that agree in both goes where.
    Slots count from 0 in each shard without gaps. Null ids and repeated rows
    are rows like others; extra columns are ignored; an empty table gives no
    rows. ``grown_shard`` is null: it belongs to the law ``key``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    same = F.concat_ws(":", F.md5(text), size.cast("string"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias(RID), size.alias("size"), F.crc32(text).alias("text_crc32"), same.alias("same"), F.xxhash64(F.lit(seed), F.col(id_col), same).alias("h"))
    rows = materialise(rows)
    total = rows.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    groups = materialise(rows.groupBy("same").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    large = groups.where(F.col("group_size") > quota[0] // _LARGE)
    sizes = {r["same"]: r["group_size"] for r in large.collect()}  # no more than _LARGE groups a shard, or a tiny table's rows
    room = list(quota)
    starts = dict(zip(sorted(sizes), itertools.accumulate([sizes[g] for g in sorted(sizes)], initial=0)))
    places = [(starts[g] + a, starts[g] + b, s) for g, a, b, s in place(sizes, room)]
    # other rows start in proportion to the room that is left
    draw = F.pmod(F.col("h"), F.lit(max(1, sum(room))))
    home = F.coalesce(*[F.when(draw < sum(room[: s + 1]), F.lit(s)) for s in range(shards)], F.lit(0))
    known = rows.join(groups, "same", "left").withColumn("shard", home).withColumn("grp", F.when(F.col("group_size").isNotNull(), F.col("same"))).drop("same")
    known = materialise(known.withColumn("placed", F.coalesce(F.col("group_size") > quota[0] // _LARGE, F.lit(False))))
    linked = propagate(materialise(known.where("grp IS NOT NULL AND NOT placed").select(RID, "grp", "shard")), shards, room, patience, seed)
    if places:
        at = number_rows(known.where("placed").select(RID, "grp", "doc_id"), [F.asc("grp"), F.asc("doc_id"), F.asc(RID)], P + "at")
        # a few places for each shard
        spots = F.broadcast(rows.sparkSession.createDataFrame(places, "first long, end long, shard int"))
        linked = linked.unionByName(at.join(spots, (F.col(P + "at") >= F.col("first")) & (F.col(P + "at") < F.col("end"))).select(RID, "grp", "shard"))
    moved = known.join(linked.select(RID, F.col("shard").alias("to")), RID, "left").withColumn("shard", F.coalesce("to", "shard")).drop("to")
    even = _even(moved.withColumn("loose", F.when(F.col("placed"), 0).when(F.col("grp").isNotNull(), 1).otherwise(2)), shards, total)
    return even.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def op5_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
