"""Exact and near copies, and repeated line runs, against brute force."""

import hashlib
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from cladewise.llm.common import RID, materialise, with_row_ids
from cladewise.llm.components import components
from cladewise.llm.exact_dedup import drop_exact_copies, exact_dedup
from cladewise.llm.line_dedup import dedup_lines
from cladewise.llm.simhash import ROOT, drop_near_copies, fingerprint, links, near_duplicates

from .conftest import edge_rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def key(i):
    return (i is None, i or 0)


def test_exact_dedup_edges(edges, nothing):
    got = exact_dedup(edges).drop(RID).collect()
    rows = edge_rows()
    ids: dict = {}
    for r in rows:
        ids.setdefault(norm(r[1]), []).append(r[0])
    want = Counter((r[0], min(ids[norm(r[1])], key=key), len(ids[norm(r[1])]), hashlib.sha256(norm(r[1]).encode()).hexdigest()) for r in rows)
    assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
    assert sum(g.kept for g in got) == len(ids)
    assert exact_dedup(nothing).count() == 0


def test_exact_dedup_survives_hash_collisions(edges):
    weak = exact_dedup(edges, content_hash=lambda c: F.substring(F.md5(c), 1, 1)).drop(RID)
    assert Counter(map(tuple, weak.collect())) == Counter(map(tuple, exact_dedup(edges).drop(RID).collect()))


def test_drop_exact_copies_keeps_columns(edges, nothing):
    kept = drop_exact_copies(edges)
    assert kept.columns == edges.columns
    assert sorted(norm(r.text) for r in kept.collect()) == sorted({norm(r[1]) for r in edge_rows()})
    assert drop_exact_copies(nothing).count() == 0


def slow_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_fingerprints():
    for r in edge_rows():
        if len(r[1] or "") < 3000:
            assert fingerprint(r[1]) == slow_fingerprint(r[1])


def test_links_find_every_pair(spark):
    rng = random.Random(1)
    fps = {0, 2**64 - 1}
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(12):
            y = x
            for _ in range(rng.randint(0, 5)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in fps], "fp long")
    for within in (3, 1):
        got = {(r.a, r.b) for r in links(df, within).collect()}
        assert got == {(a, b) for a in map(signed, fps) for b in map(signed, fps) if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= within}


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 3000 + i) for i in range(50)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {v: find(v) for v in parent if v in got}
    assert set(parent) - set(got) <= {a for a, b in edges if a == b}


def test_near_duplicates_edges(edges, nothing):
    got = near_duplicates(edges).drop(RID, ROOT).collect()
    rows = edge_rows()
    fp = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fp[i] ^ fp[j]).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    first = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in group}
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((r[0], f"{f:016x}", first[g]) for r, f, g in zip(rows, fp, group))
    kept = drop_near_copies(edges)
    assert kept.columns == edges.columns and kept.count() == len(set(group))
    assert near_duplicates(nothing).count() == 0 and drop_near_copies(nothing).count() == 0


def brute_lines(docs, least):
    """Each place against each earlier one: as far as both agree and do not overlap, the later lines go if they have words enough."""
    seq = [(i, at, no, line.strip(" \t\n\x0b\f\r"), len(line.split())) for at, (i, t) in enumerate(sorted(docs, key=lambda d: key(d[0]))) if t is not None for no, line in enumerate(t.split("\n")) if line.strip()]
    gone = {}
    for p in range(len(seq)):
        for q in range(p):
            n = words = 0
            while n < p - q and p + n < len(seq) and seq[p + n][3] == seq[q + n][3] and seq[p + n][1] == seq[p][1] and seq[q + n][1] == seq[q][1]:
                words += seq[p + n][4]
                n += 1
            if words >= least:
                for r in seq[p : p + n]:
                    gone.setdefault(r[0], set()).add(r[2])
    return {i: sorted(v) for i, v in gone.items()}


def test_line_dedup_deletes_maximal_runs(spark):
    a, b, m = " ".join(["a"] * 35), " ".join(["b"] * 25), "m m m m m"
    docs = [(1, f"{a}\n{b}\nx"), (2, f"{a}\n{b}\n{m}"), (3, f"y\n{a}\n{b}\n{m}\nz"), (4, f"{m}\n{m}")]
    got = {r.doc_id: list(r.deleted_lines) for r in dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0, 1], 3: [1, 2, 3], 4: []}


def test_first_copies_stay_whole(spark):
    """Runs that overlap their own copies, alone and beside others, judged by what is left."""
    rng = random.Random(7)
    part = lambda n, w: [" ".join(rng.choice("abcdefgh") for _ in range(w)) + f" {rng.random()}" for _ in range(n)]
    period, passage = part(3, 4), part(9, 7)
    docs = {1: ["a a"] * 60, 2: ["b b b b"] * 60, 3: ["a a"] * 30, 4: ["c"] * 49, 5: ["d"] * 51, 6: period * 40, 7: ["top", *passage, "mid", *passage, "end"], 8: [*passage, "tail"], 9: ["e e", "f"] * 200, 10: ["e e", "f"] * 300}
    got = {r.doc_id: r for r in dedup_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in docs.items()], "doc_id long, text string")).collect()}
    left = {i: got[i].text.split("\n") if got[i].text else [] for i in docs}
    assert left[1] == ["a a"] * 25 and left[3] == [] and left[4] == ["c"] * 49 and left[5] == ["d"] * 51
    for i in (1, 2, 6, 7, 9):
        assert sum(len(x.split()) for x in left[i]) >= 50 and left[i][: len(left[i]) - 1] == docs[i][: len(left[i]) - 1]
    whole = "\n".join("\n".join(left[i]) for i in sorted(left))
    assert whole.count("\n".join(passage)) == 1 and left[8] == ["tail"] and left[10] == []
    standing = {x for t in left.values() for x in t}
    assert all(x in standing for t in docs.values() for x in t)
    # a deleted window still stands whole once; of a period of several lines one turn does, not each
    for i in (1, 2, 3, 4, 5, 7, 8):
        t = docs[i]
        for a in range(len(t)):
            n = next((n for n in range(1, len(t) - a + 1) if sum(len(x.split()) for x in t[a : a + n]) >= 50), None)
            if n and all(k in set(got[i].deleted_lines) for k in range(a, a + n)):
                assert "\n".join(t[a : a + n]) in whole


def test_line_dedup(spark, edges, nothing):
    rng = random.Random(3)
    lines = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    docs = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.8 else rng.choice(["", f"u{rng.random()} x"]) for _ in range(rng.randint(0, 25)))) for i in range(40)]
    docs += [(40, docs[3][1]), (41, docs[3][1]), (42, None), (43, ""), (44, docs[3][1] + "\nzz\n" + docs[5][1])]
    for least in (5, 9):
        got = dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), min_words=least).collect()
        want = brute_lines(docs, least)
        assert {r.doc_id: list(r.deleted_lines) for r in got if r.deleted_lines} == want
        for r in got:
            t = dict(docs)[r.doc_id]
            assert r.text == (t if r.doc_id not in want else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in want[r.doc_id]))
    got = dedup_lines(edges).collect()
    assert len(got) == len(edge_rows()) and sum(r.deleted_words == 30_000 for r in got) == 1
    assert [r.text for r in got if r.doc_id == 0] == [None]
    assert dedup_lines(nothing).count() == 0


def test_row_ids_are_unique_and_stay(spark, edges, tmp_path):
    edges.select("doc_id", "text").repartition(3).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    for df in (stored, stored.union(stored), stored.where("doc_id > 3").withColumn("n", F.explode(F.array(F.lit(1), F.lit(2))))):
        held = with_row_ids(df)
        first = {r[RID]: (r.doc_id, r.text) for r in held.collect()}
        assert len(first) == df.count() and held.columns == [*df.columns, RID]
        again = {r[RID]: r.doc_id for r in held.select("doc_id", RID).collect()}
        assert again == {k: v[0] for k, v in first.items()}


def test_links_are_not_broadcast(spark):
    """An exploded side has 36 rows a fingerprint, whatever Spark takes it for."""
    distinct = materialise(spark.range(1000).select(F.xxhash64("id").alias("fp")))
    assert "Broadcast" not in links(distinct)._jdf.queryExecution().executedPlan().toString()


def test_texts_without_copies_are_not_broadcast(spark):
    """Nearly every row's hash is on the other side of that join."""
    df = materialise(spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text")))
    plan = exact_dedup(df)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
