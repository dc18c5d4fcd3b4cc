"""The pipeline's stages, each against a plain computation of what it must keep from its own input."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from cladewise.llm.packing import cut
from cladewise.llm.quality import THRESHOLD, features, train

from .conftest import SCHEMA, edge_rows
from .test_dedup import norm, slow_fingerprint
from .test_mix_pack_shard import targets

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def key(row):
    return (row.doc_id is None, row.doc_id or 0)


def kept_by_quality(rows, model):
    return Counter(r for r in rows if model.score(features(r.text)[None])[0] >= THRESHOLD)


def kept_by_exact(rows):
    least = {}
    for r in rows:
        least[norm(r.text)] = min(least.get(norm(r.text), r), r, key=key)
    return Counter((r.doc_id, norm(t)) for t, r in least.items())


def kept_by_near(rows):
    fp, group = [slow_fingerprint(r.text) for r in rows], list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = {}
    for i, r in enumerate(rows):
        least[root(i)] = min(least.get(root(i), r), r, key=key)
    return Counter(r.doc_id for r in least.values())


def check_mixing(rows, got):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
        largest[r.source] = max(largest[r.source], words(r.text))
    for r in got:
        taken[r.source] += words(r.text)
    before, after = Counter(rows), Counter(got)
    assert all(n <= 2 * before[r] for r, n in after.items())
    goal = targets(sizes) if any(sizes.values()) else {}
    assert all(abs(taken[s] - goal[s]) <= max(1, largest[s]) for s in goal)


def check_packing(rows, got):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want, by_row, found = Counter(), defaultdict(list), Counter()
    for r in rows:
        ids, at, pieces = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], 0, []
        for n in cut(len(ids)):
            pieces.append((at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at += n
        want[r.doc_id, tuple(pieces)] += 1
    for r in got:
        by_row[r.row].append(r)
    for pieces in by_row.values():
        found[pieces[0].doc_id, tuple(sorted((p.start, p.length, p.ids_crc32) for p in pieces))] += 1
    assert found == want and sorted(r.sequence_id for r in got) == list(range(len(got)))


def run_stages(spark, docs, folder):
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows = docs.collect()
        docs = corpus_pipeline.materialise(stage(spark, docs, folder))
        got = docs.collect()
        if name == "quality":
            model = train(spark.createDataFrame(rows, docs.schema), corpus_pipeline.table(spark, folder, "labels"))
            assert Counter(got) == kept_by_quality(rows, model)
        elif name == "exact_dedup":
            assert Counter((r.doc_id, norm(r.text)) for r in got) == kept_by_exact(rows)
        elif name == "simhash_near_dedup":
            assert Counter(r.doc_id for r in got) == kept_by_near(rows)
        elif name == "mixing":
            check_mixing(rows, got)
        else:
            check_packing(rows, got)
        if name != "packing":
            assert docs.columns == columns
    return docs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages(spark):
    pieces = run_stages(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
    assert corpus_pipeline.run(spark, SF).count() == pieces.count() > 0


def test_stages_on_odd_rows_and_none(spark, tmp_path):
    labels = [(r[0], 1, 0) for r in edge_rows() if r[0] is not None and r[0] % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(edge_rows(), SCHEMA).coalesce(2).write.parquet(str(tmp_path / "odd"))
    run_stages(spark, spark.read.parquet(str(tmp_path / "odd")), str(tmp_path))
    assert run_stages(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).count() == 0
