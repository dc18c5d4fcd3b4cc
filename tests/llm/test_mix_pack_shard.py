"""Mixing, packing and sharding: laws, contracts and edges."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladewise.llm.common import RID
from cladewise.llm.mixing import SEED, apply_mix, mix
from cladewise.llm.packing import cut, pack
from cladewise.llm.sharding import shard_documents

from .conftest import edge_rows


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), {}
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > cap * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= full
    return out


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(n)), None if i % 11 == 0 else f"s{i % 5}") for i, n in enumerate(rng.integers(1, 60, 3000))]
    rows += [(9000 + i, "a b c d", "big") for i in range(1500)]
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, source = targets(sizes), {i: s for i, _, s in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(df).collect()
    taken = defaultdict(int)
    for r in got:
        taken[source[r.doc_id]] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(want[source[r.doc_id]], rel=1e-9) and abs(r.taken - r.expected_copies * r.size) < r.size + 1e-6
    assert all(abs(taken[s] - want[s]) <= 31 for s in want)
    again = mix(df.repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    flat = Counter(r.doc_id for r in apply_mix(df).collect())
    assert flat == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mix_edges(edges, nothing):
    got = mix(edges).collect()
    assert len(got) == len(edge_rows()) and all(r.taken == r.copies * r.size <= 2 * r.size for r in got)
    assert apply_mix(edges).columns == edges.columns
    assert mix(nothing).count() == 0 and apply_mix(nothing).count() == 0


def test_cut():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000):
        assert sum(cut(n)) == n and all(p & p - 1 == 0 for p in cut(n)) and len(set(cut(n)[n // 2048 :])) == len(cut(n)[n // 2048 :])


def test_pack_round_trip(edges, nothing):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = edge_rows()
    got = pack(edges).collect()
    assert sorted(r.sequence_id for r in got) == list(range(len(got))) and all(r.offset == 0 and r.length == r.bucket for r in got)
    lengths = [r.length for r in sorted(got, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    by_row = defaultdict(list)
    for r in got:
        by_row[r[RID]].append(r)
    found = Counter()
    for pieces in by_row.values():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:i]) for i in range(len(pieces))]
        found[pieces[0].doc_id, tuple((p.length, p.ids_crc32) for p in pieces), pieces[0].doc_tokens] += 1
    want = Counter()
    for r in rows:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]
        parts, at = [], 0
        for n in cut(len(ids)):
            parts.append((n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        want[r[0], tuple(parts), len(ids)] += 1
    assert found == want
    assert pack(nothing).count() == 0


def test_shards_keep_the_law(spark, edges, nothing):
    got = shard_documents(edges).collect()
    assert len(got) == len(edge_rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in edge_rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    check_law(got)
    assert shard_documents(nothing).count() == 0
    # a third of all rows in one group, and many small groups
    rows = [(i, "hot") for i in range(400)] + [(400 + i, f"t{i % 250}") for i in range(800)]
    got = shard_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_law(got)
    groups = defaultdict(Counter)
    for r in got:
        groups[r.text_crc32][r.shard] += 1
    cut_groups = [g for c, g in groups.items() if len(g) > 1]
    assert len(cut_groups) < 30, len(cut_groups)


def test_shards_cut_only_what_no_shard_holds(spark):
    rows = ["hot"] * 400 + ["tenth"] * 120 + ["other"] * 110 + [f"t{i % 200}" for i in range(400)] + [f"u{i}" for i in range(170)]
    got = shard_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    check_law(got)
    held = defaultdict(set)
    for r in got:
        held[rows[r.doc_id]].add(r.shard)
    assert (len(held["hot"]), len(held["tenth"]), len(held["other"])) == (3, 1, 1)
    assert sum(len(s) > 1 for s in held.values()) < 8
    # so many small groups that eight rounds leave many apart
    rows = [f"t{i % 4000}" for i in range(8000)]
    got = shard_documents(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    check_law(got)
    held = defaultdict(set)
    for r in got:
        held[rows[r.doc_id]].add(r.shard)
    assert sum(len(s) > 1 for s in held.values()) < 8


def check_law(got):
    counts = Counter(r.shard for r in got)
    sizes = [counts[s] for s in range(8)]
    assert max(sizes) - min(sizes) <= 1 and {r.law for r in got} == {"rows"}
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))


def test_propagation_saves_links_and_ignores_partitions(spark):
    rng = np.random.default_rng(6)
    rows = [(i, f"t{t}") for i, t in enumerate(rng.integers(0, 900, 3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    cut_links = lambda shard: sum(n * (n - 1) // 2 for n in Counter(t for _, t in rows).values()) - sum(n * (n - 1) // 2 for n in Counter((t, shard[i]) for i, t in rows).values())
    got = {r.doc_id: r.shard for r in shard_documents(df).collect()}
    alone = {r.doc_id: r.shard for r in shard_documents(df, patience=0).collect()}  # no round helps
    assert cut_links(got) < 0.02 * cut_links({i: i % 8 for i, _ in rows}) and cut_links(got) <= cut_links(alone)
    assert got == {r.doc_id: r.shard for r in shard_documents(df.repartition(5)).collect()}


def test_mix_takes_the_least_ranks(spark):
    """Which rows are taken, by plain sorting of random odds over inclusion odds; and inclusion by its odds."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(["w"] * int(n)), f"s{i % 4}") for i, n in enumerate(rng.choice([3, 9, 40, 200], 4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    hashes = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64(F.lit(SEED), "doc_id", "text").alias("h")).collect()}
    got = {r.doc_id: r for r in mix(df).collect()}
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = targets(sizes)
    for source in sizes:
        mine = [(i, len(t.split())) for i, t, s in rows if s == source]
        weight = {i: n.bit_length() for i, n in mine}
        low, high = 0.0, 4.0
        for _ in range(200):  # the factor whose expected copies meet the target
            c = (low + high) / 2
            low, high = (c, high) if sum(n * min(2.0, c * weight[i]) for i, n in mine) < want[source] else (low, c)
        copies = {i: min(2.0, high * weight[i]) for i, _ in mine}
        certain = {i: int(copies[i] + 1e-9) for i, _ in mine}
        need = want[source] - sum(n * certain[i] for i, n in mine)
        rank, extra, total = {}, {}, 0
        for i, n in mine:
            p, u = copies[i] - certain[i], (((hashes[i] & (1 << 64) - 1) >> 12) + 0.5) / (1 << 52)
            if p > 1e-9:
                rank[i] = u / (1 - u) * (1 - p) / p
        for i, n in sorted(((i, n) for i, n in mine if i in rank), key=lambda x: (rank[x[0]], x[0])):
            total += n
            extra[i] = int(total <= need or total - n < need and total - need < need - (total - n))
        assert {i: got[i].copies for i, _ in mine} == {i: certain[i] + extra.get(i, 0) for i, _ in mine}
        for level in set(weight.values()):  # documents of one weight are taken by their odds
            some = [i for i, _ in mine if weight[i] == level and i in rank]
            if len(some) > 100:
                assert abs(sum(extra[i] for i in some) / len(some) - np.mean([copies[i] - certain[i] for i in some])) < 0.1
