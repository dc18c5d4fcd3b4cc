"""Quality classifier, language model, licence scan and top-k search."""

import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladewise.llm import attention as net
from cladewise.llm.bitsliced import top_k
from cladewise.llm.common import few_rows
from cladewise.llm.licences import RULES, SENTENCES, oracle_sql, parts_of, scan, sequences, sign
from cladewise.llm.lm import Subwords, _class_scores, numbered_words, score_texts, slices, text_words, training_windows
from cladewise.llm.quality import estimate_prior, features, fit, keep_good, score, train

from .conftest import LONG, edge_rows


def test_prior_and_nonnegative_risk():
    rng = np.random.default_rng(0)
    pos, unl = rng.normal(2, 1, (1500, 4)), np.r_[rng.normal(2, 1, (14000, 4)), rng.normal(-2, 1, (6000, 4))]
    model = fit(pos, unl[::10], lambda f: f(unl))
    assert 0.6 < model.prior < 0.8
    assert (model.score(rng.normal(2, 1, (500, 4))) > 0.5).mean() > 0.95 and (model.score(rng.normal(-2, 1, (500, 4))) < 0.3).mean() > 0.95
    assert estimate_prior(np.zeros(0), np.zeros(0), 3, np.zeros(0)) == 0.5


def test_fit_holds_its_rows_once():
    """The fit runs on the driver: beside one table of all its rows in 64 bits it may hold half of that again, and some."""
    rng = np.random.default_rng(4)
    pos, unl = rng.random((2000, 300)).astype(np.float32), rng.random((2000, 300)).astype(np.float32)
    tracemalloc.start()
    fit(pos, unl, lambda f: f(unl[:100]), steps=5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 2.5 * 4000 * 301 * 8


def test_texts_come_a_few_at_a_time():
    """Every row once and in order, whatever the batches, and never more than a few of them as strings at once."""
    batches = [pa.RecordBatch.from_pydict({"t": [f"{k} {i}" for i in range(n)]}, pa.schema([("t", pa.string())])) for k, n in enumerate((0, 1, 1300, 512))]
    found = list(few_rows(iter(batches)))
    assert [b.num_rows for b in found] == [1, 512, 512, 276, 512]
    assert [t for b in found for t in b.column("t").to_pylist()] == [t for b in batches for t in b.column("t").to_pylist()]


def test_all_unlabelled_rows_decide_the_fit():
    """The least value of the unbiased risk over all rows, found by plain descent, is where the steps end, however the sample was drawn."""
    rng = np.random.default_rng(3)
    pos, unl = rng.normal(0.5, 1, (600, 3)), np.r_[rng.normal(0.5, 1, (3000, 3)), rng.normal(-0.7, 1, (3000, 3))]
    for sample in (unl[::7], unl[3::11]):
        model = fit(pos, sample, lambda f: f(unl), passes=12)
        e = lambda x: np.c_[((x - model.mean) / model.scale).clip(-8, 8), np.ones(len(x))]
        p, u, w = e(pos), e(unl), np.zeros(4)
        for _ in range(20000):
            w -= 0.2 * (u.T @ (1 / (1 + np.exp(-u @ w))) / len(u) - model.prior * p.mean(0) + 0.003 * np.r_[w[:-1], 0])
        assert np.r_[model.weight, model.bias] == pytest.approx(w, abs=0.02)


def test_quality_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(i, int(i % 6 > 0), None) for i in range(30)] + [(None, 1, 1), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    model = train(edges, labels)
    got = score(edges, model).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in got)
    assert keep_good(edges, model).columns == edges.columns
    assert score(nothing, model).count() == 0
    none = train(nothing, labels.where("false"))
    assert {r.score for r in score(edges, none).collect()} == {0.5}
    assert np.isfinite(features(LONG)).all() and not features(None).any()
    # an id in very many rows gives one positive, and another layout the same model
    many = edges.select("doc_id", "text").union(spark.range(3000).selectExpr("4 AS doc_id", "concat('again ', id % 50) AS text"))
    a, b = train(many.coalesce(1), labels), train(many.repartition(6), labels)
    assert np.allclose(a.weight, b.weight) and a.prior == b.prior


def test_quality_held_out(spark):
    rng = np.random.default_rng(1)
    good = lambda: " ".join("".join(rng.choice(list("aeinrst"), rng.integers(2, 8))) for _ in range(60)).capitalize() + "."
    bad = lambda: " ".join("".join(rng.choice(list("AEINRST"), rng.integers(2, 8))) + "!!" for _ in range(60))
    docs = [(i, bad() if i % 6 == 0 else good()) for i in range(1200)]
    labels = [(i, int(i % 6 != 0), 0) for i in range(0, 1200, 2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = score(df, train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).where("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id % 6 != 0) for r in got]) > 0.98


def some_words(rng, n, classes, slots):
    """FILL, START and n words of one to three subwords."""
    lengths = np.r_[1, 1, rng.integers(1, 4, n)]
    return net.Words(np.r_[net.FILL, net.START, rng.integers(2, slots, lengths[2:].sum())], lengths, np.r_[-1, -1, rng.integers(0, classes, n)])


def test_attention_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in net.unflatten(net.initial(rng.integers(1, 50, 9).astype(float), 20, 1), 9, 20).items()}
    words = some_words(rng, 30, 9, 20)
    w = rng.integers(2, 32, (3, net.SPAN + net.STRIDE))
    w[0, : net.SEEN], w[0, net.SEEN], w[1, -5:] = net.FILL, net.START, net.FILL
    _, g = net.gradients(p, words, w)
    for k in p:
        at = (int(words.some(w[2, 3:4]).slots[0]), 1) if k == "E" else tuple(rng.integers(0, n) for n in p[k].shape)
        ends = []
        for step in (1e-5, -1e-5):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            ends.append(net.gradients(q, words, w)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-4, abs=1e-8)


def naive_log_prob(p, inputs, place, target):
    """Attention of one place over the inputs up to it, each given by its slots, in plain loops."""
    x = [np.mean([p["E"][s] for s in slots], axis=0) + p["P"][i] for i, slots in inputs]
    q = x[-1] @ p["Wq"] / np.sqrt(net.DIM)
    a = [np.exp(q @ (v @ p["Wk"])) for v in x]
    mixed = sum(w * (v @ p["Wv"]) for w, v in zip(a, x)) / sum(a)
    h = x[-1] + mixed @ p["Wo"]
    y = h + np.maximum(h @ p["W1"] + p["b1"], 0) @ p["W2"]
    logits = y @ p["U"] + p["b"]
    return logits[target] - np.log(np.exp(logits).sum())


def test_scores_equal_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    p = net.unflatten(rng.normal(0, 0.4, len(net.initial(np.ones(9), 20, 1))), 9, 20)
    words = some_words(rng, 30, 9, 20)
    lengths = np.array([1, net.STRIDE, net.STRIDE + 1, 75])
    numbers = rng.integers(2, 32, lengths.sum()).astype(np.int32)
    got, at = _class_scores(p, words, numbers, lengths, size=2), 0
    wide = {k: v.astype(float) for k, v in p.items()}
    slots = lambda n: words.some(np.array([n])).slots
    for n in lengths:
        text = [net.START, *numbers[at : at + n]]
        for i in range(n):
            window = i // net.STRIDE * net.STRIDE - net.SEEN  # the text's place of the window's first input
            inputs = [(j - window, slots(text[j])) for j in range(max(0, window), i + 1)]
            assert got[at + i] == pytest.approx(naive_log_prob(wide, inputs, i, words.kinds[numbers[at + i]]), rel=1e-4, abs=1e-4)
        at += n


def test_groups_of_classes():
    rng = np.random.default_rng(7)
    classes, slots = 2 * net._GROUP + 5, 20
    p = net.unflatten(rng.normal(0, 0.4, len(net.initial(np.ones(classes), slots, 1))), classes, slots)
    p = {k: v.astype(float) for k, v in p.items()}
    words = some_words(rng, classes, classes, slots)
    words.kinds[2:] = np.arange(classes)  # a word of each class
    w = rng.integers(2, 2 + classes, (3, net.SPAN + net.STRIDE))
    w[0, : net.SEEN], w[0, net.SEEN], w[1, -5:] = net.FILL, net.START, net.FILL
    total = 0.0
    for k in range(classes):
        each = w.copy()
        each[:, net.SPAN :] = 2 + k
        total = total + np.exp(net.log_probs(p, words.embed(p["E"]), each, words.kinds))
    assert total == pytest.approx(np.ones(3 * net.STRIDE))
    loss, g = net.gradients(p, words, w)
    found = net.log_probs(p, words.embed(p["E"]), w, words.kinds)
    assert loss == pytest.approx(-found.sum() / (3 * net.STRIDE - 5))
    for k in p:
        at = tuple(rng.integers(0, n) for n in p[k].shape) if k != "E" else (int(words.some(w[2, 3:4]).slots[0]), 1)
        ends = []
        for step in (1e-5, -1e-5):
            q = {a: b.copy() for a, b in p.items()}
            q[k][at] += step
            ends.append(net.gradients(q, words, w)[0])
        assert (ends[0] - ends[1]) / 2e-5 == pytest.approx(g[k][at], rel=1e-4, abs=1e-8)
    # all classes but none of their columns are alike: the start gives the classes' own frequencies
    counts = rng.integers(0, 99, classes).astype(float)
    start = net.unflatten(net.initial(counts, slots, 1), classes, slots)
    of = np.arange(classes) // net._GROUP
    within = np.exp(start["b"]) / np.bincount(of, np.exp(start["b"]))[of]
    assert within * (np.exp(start["c"]) / np.exp(start["c"]).sum())[of] == pytest.approx((counts + 1) / (counts + 1).sum(), rel=1e-4)


def test_long_words_keep_all_their_subwords():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 1, 1, 4, 5, 30, 2])
    words = net.Words(rng.integers(0, 20, lengths.sum()).astype(np.uint16), lengths, np.zeros(7, int))
    table, some = rng.normal(size=(20, net.DIM)), np.array([5, 0, 3, 4, 5, 6, 2])
    mean = np.zeros((7, 20))
    for i, (a, n) in enumerate(zip(words.starts, lengths)):
        np.add.at(mean[i], words.slots[a : a + n], 1 / n)
    assert words.embed(table) == pytest.approx(mean @ table) and words.embed(table, some) == pytest.approx(mean[some] @ table)
    slopes = rng.normal(size=(7, net.DIM))
    assert words.spread(slopes, some, 20) == pytest.approx(mean[some].T @ slopes)


ODD = [None, "", "   ", "\n\t ", " The the THE's don't x1y2 ", "\x1c odd \x00   \ud7ff", "A\u00c9 \u3000b\x85c d\xa0e \u00e9t\u00e9 \u65e5\u672c\u8a9e", "<|endoftext|> ''ll " + "\u3000" * 3000 + "x" * 3000]


def test_words_are_numbered_as_they_are_cut():
    numbers, lengths, words = numbered_words(ODD)
    assert [words[i - 2].encode() for i in numbers] == [w for t in ODD for w in text_words(t)]
    assert lengths.tolist() == [len(text_words(t)) for t in ODD] and len(set(words)) == len(words)
    assert numbered_words([])[1].tolist() == []


def test_subwords_are_those_of_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    words = [w for w in numbered_words([*ODD, *(r[1] for r in edge_rows())])[2] if "<|" not in w]
    subwords = Subwords(path)
    plain, slow = Tokenizer.from_file(path), []
    subwords._ids = lambda texts, f=subwords._ids: slow.extend(texts) or f(texts)
    ids, pieces = subwords(words)
    want = [plain.encode(" " + w, add_special_tokens=False).ids if w else [] for w in words]
    assert pieces.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    # the slower tokenizer is left with words that have blanks in them
    assert all(any(not c.isascii() and c.isspace() or c == "\x1c" for c in t) for t in slow)
    other = Subwords(public_tokenizers.path("word_bpe_49k.json"))
    assert other.fast is None and len(other(["", "one", "two"])[1]) == 3


def test_windows_score_each_token_once():
    lengths = np.array([1, 32, 33, 80, 3])
    numbers = np.arange(2, 2 + lengths.sum()).astype(np.int32)
    stream, windows, place = net.layout(numbers, lengths)
    assert len(set(place.tolist())) == lengths.sum()
    at = 0
    for n in lengths:
        for i in range(n):
            window, row = divmod(int(place[at + i]), net.STRIDE)
            seen = stream[windows[window] : windows[window] + net.SEEN + row + 1]
            seen = [x for x in seen.tolist() if x != net.FILL]
            want = [net.START, *numbers[at : at + i].tolist()]
            assert seen == want[-len(seen) :] and len(seen) >= min(i + 1, net.SEEN + 1)
        at += n


def test_lm_edges(edges, nothing):
    got = score_texts(edges).collect()
    rows, c = edge_rows(), Counter()
    out = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    for r in rows:
        if not out(r[0]):
            c.update(text_words(r[1]))
    total = sum(c.values())
    want = Counter((r[0], out(r[0]), len(text_words(r[1])), sum(c[w] > 0 for w in text_words(r[1])), total, round(sum(np.log10((c[w] + 1) / (total + len(c) + 1)) for w in text_words(r[1])), 3)) for r in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    assert score_texts(nothing).count() == 0


def test_lm_beats_unigrams_on_held_out_text(spark):
    rng = np.random.default_rng(3)
    follows = {w: rng.choice(list("abcdefgh"), 2) for w in "abcdefgh"}

    def text():
        w, out = "a", []
        for _ in range(80):
            w = rng.choice(follows[w])
            out.append(w * 3)
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    got = score_texts(df).where("held_out").collect()
    assert np.mean([r.score > r.base_score for r in got]) > 0.95


def test_lm_trains_on_all_windows(spark):
    lengths, held = np.array([1, 70, 33, 32]), np.array([False, True, False, False])
    numbers = np.arange(2, 2 + lengths.sum()).astype(np.int32)
    targets = training_windows(numbers, lengths, held)[:, net.SPAN :]
    assert sorted(targets[targets != net.FILL]) == sorted(numbers[np.repeat(~held, lengths)])
    for n in (0, 1, 3, 100, 400):
        marks = [(i * 7919) % 1009 for i in range(n)]
        rounds = slices(marks)
        assert sorted(m for a, b in rounds for m in marks if a <= m <= b) == sorted(marks)
        assert len(rounds) == min(n, max(4, int(n**0.5)))
    # a word fixes the next one but for one of two: log10(1/2) a word; with a 32nd of the windows the order of the words is not learnt
    rng = np.random.default_rng(8)
    follows = {w: rng.choice(list("abcdefgh"), 2, replace=False) for w in "abcdefgh"}

    def text():
        w, out = "a", []
        for _ in range(80):
            w = rng.choice(follows[w])
            out.append(w * 3)
        return " ".join(out)

    df = spark.createDataFrame([(i, text()) for i in range(1500)], "doc_id long, text string")
    held = df.where("crc32(cast(doc_id as string)) % 7 = 2")
    got = score_texts(df).where("held_out").collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -0.45 and len(got) == held.count()


def test_lm_does_not_depend_on_partitions(spark, edges):
    rng = np.random.default_rng(9)
    syllables = ["er", "in", "tion", "the ", "of ", "re", "an "]
    df = spark.createDataFrame([(i, "".join(rng.choice(syllables, 60))) for i in range(300)], "doc_id long, text string")
    for rows in (df, edges.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        one = {r.doc_id: r.score for r in score_texts(rows.coalesce(1), bucket_bytes=5000).collect()}
        many = {r.doc_id: r.score for r in score_texts(rows.repartition(7), bucket_bytes=5000).collect()}
        assert one.keys() == many.keys() and all(one[i] == pytest.approx(many[i], rel=1e-6) for i in one)


def brute_top(rows, k=20, every=20):
    ok = [(i, np.floor(64 * np.array(v, float))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i % every == 0:
            scores = sorted(((-int(sum(a * b for a, b in zip(q, x))), j) for m, (j, x) in enumerate(ok) if m != n))[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores, 1)]
    return Counter(out)


def test_top_k(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in range(500)]
    rows += [(500 + i, rows[3][1]) for i in range(90)] + [(700, None), (720, [1.0, None]), (740, [float("nan")] * 16), (760, [float("inf")] * 16), (None, rows[0][1]), (780, [0.0] * 16), (800, [-1e6] * 16), (820, [0.5, 0.25]), (840, [])]
    rows += [rows[40], rows[41]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute_top([(i, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows])
    for block in (1 << 15, 100):
        assert Counter(map(tuple, top_k(df, block=block).collect())) == want
    clash = df.selectExpr("*", "1 AS b", "'x' AS q", "2.5 AS v", "3 AS score", "4 AS rank", "5 AS pass", "vec_id AS query_id")
    assert Counter(map(tuple, top_k(clash, block=100).collect())) == want
    few = df.where("vec_id in (20, 21, 22)")
    assert Counter(map(tuple, top_k(few).collect())) == brute_top([r for r in rows if r[0] in (20, 21, 22)])
    assert top_k(df.where("false")).count() == 0


def test_licences(spark, edges, nothing):
    mit = "\n".join(["Prose", "Copyright (c) 2020 Foo", *[SENTENCES[k].replace("copies of", "copies\nof").replace("THE WARR", "THE\nWARR") for k in ("MITgrant", "MITcond", "MITwarr", "MITliab")]])
    apache = "\n".join(SENTENCES[k] for k in ("Ap2grant", "Ap2comply", "Ap2copy", "Ap2asis", "Ap2see"))
    rows = [(1, mit), (2, apache), (3, "LOUD!! X\nReleased under the MIT License.\nfoo. Licensed under CC BY-NC 4.0."), (4, "// SPDX-License-Identifier: Apache-2.0\nx"), (5, SENTENCES["MITliab"]), (6, "a licence to print money")]
    got = {r.doc_id: r for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].licences for i in range(1, 7)] == [["MIT"], ["Apache-2.0"], ["CC-BY-NC-4.0", "MIT"], ["Apache-2.0"], [], []]
    assert got[5].left_over == ["MITliab"] and got[1].left_over == [] and got[1].sentence_ids[0] == "Copyright"
    edge = scan(edges).collect()
    assert len(edge) == len(edge_rows()) and all(r.licences == [] for r in edge)
    assert scan(nothing).count() == 0
    assert all(any(w in t.lower() for w in sign(SENTENCES)) for t in SENTENCES.values()) and {i for seq, _ in RULES for i in seq} <= set(SENTENCES)
    assert len(sequences(SENTENCES)) == len(SENTENCES) and parts_of("A, b; c.\nD") == ["a b", "c", "d"]


def licence_rows():
    gpl, s = SENTENCES["GPL2free"], SENTENCES
    bsd = "\n".join(s[k] for k in ("BSDgrant", "BSDsrc", "BSDbin", "BSDend", "BSDwarr")).replace("the copyright holder nor", "the University nor")
    wrap = lambda t: re.sub(r"(.{30}\S*) ", r"\1\n", t)
    return [
        (gpl, ["GPL-2.0-or-later"]),
        (gpl.replace("version 2", "version 3"), ["GPL-3.0-or-later"]),
        (gpl.split("either")[0] + "version 2 of the License.", ["GPL-2.0-only"]),
        (gpl.split("either")[0], []),
        (bsd, ["BSD-3-Clause"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", ["MPL-1.1"]),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["MPL-2.0"]),
        ("The parser of Foo is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["GPL-3.0-or-later"]),
        ("nothing of the kind: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", []),
        ("Released under the MIT License\n\n" + wrap(" ".join(s[k] for k in ("Ap2grant", "Ap2comply", "Ap2copy", "Ap2asis", "Ap2see"))), ["Apache-2.0", "MIT"]),
        (wrap(" ".join(s[k] for k in ("Zlibasis", "Zlibliab", "Zlibgrant"))), ["Zlib"]),
        (wrap(" ".join(s[k] for k in ("BSDgrant", "BSDsrc", "BSDbin", "BSDwarr", "BSDliab"))), ["BSD-2-Clause"]),
        ("SPDX-License-Identifier: MIT\nCopyright (c) 2020 X\n" + s["BSDliab"], ["MIT"]),
        (None, []),
        ("copyright", []),
        ("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;", ["Apache-2.0", "MIT"]),
        ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", ["GPL-2.0-only WITH Linux-syscall-note"]),
        ("# SPDX-License-Identifier: (MIT  AND (GPL-2.0-or-later WITH Classpath-exception-2.0\tOR BSD-3-Clause))", ["BSD-3-Clause", "GPL-2.0-or-later WITH Classpath-exception-2.0", "MIT"]),
        ("(SPDX-License-Identifier: MIT) and more", ["MIT"]),
        ("SPDX-License-Identifier: MIT or not", ["MIT"]),
        ("We quote it. The licenses for most software are designed to take away your freedom to share and change it. So they say.", []),
        (wrap("Preamble\n\n" + s["GPL2body"] + " " + s["GPL2contrast"]), ["GPL-2.0-only"]),
        (" ".join(s[k] for k in ("GPL3body", "GPL3take", "GPL3contrast")), ["GPL-3.0-only"]),
        (" ".join(s[k] for k in ("AGPL3body", "GPL3take", "AGPL3contrast")), ["AGPL-3.0-only"]),
        ("Foo. It is distributed under the terms of the MIT license. Bar.", ["MIT"]),
        ("Licensed under the Apache License 2.0.", ["Apache-2.0"]),
        ("License\n\nGNU General Public License, version 2.", ["GPL-2.0-only"]),
        ("The code in this folder is also available under the GNU GPL v3 or later.", ["GPL-3.0-or-later"]),
        ("All files of ours are published under the GNU Lesser General Public License v2.1.", ["LGPL-2.1-only"]),
        ("This file is not licensed under the MIT license. Nothing here was ever said to be released under the MIT license.", []),
    ]


def test_licences_match_every_part_in_order(spark):
    rows = licence_rows()
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(df).collect()}
    assert [got[i].licences for i in range(len(rows))] == [want for _, want in rows]
    assert got[12].sentence_ids == ["SPDX:MIT", "Copyright", "BSDliab"] and got[12].left_over == ["BSDliab"]
    said = {i: got[i].expressions for i in got if got[i].expressions}
    assert list(said.values()) == [["MIT"], ["MIT OR Apache-2.0"], ["GPL-2.0-only WITH Linux-syscall-note"], ["(MIT AND (GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause))"], ["MIT"], ["MIT"]]
    assert got[16].sentence_ids == ["SPDX:GPL-2.0-only_WITH_Linux-syscall-note"]
    own = scan(spark.createDataFrame([(1, "Hi. You may share this work freely. Bye."), (2, "freely")], "doc_id long, text string"), sentences={"X": "You may share this work freely."}, rules=[(("X",), "Custom")])
    assert {r.doc_id: r.licences for r in own.collect()} == {1: ["Custom"], 2: []}


def test_licences_equal_sql_on_odd_texts(spark, edges):
    import duckdb
    import pandas as pd

    texts = [t for t, _ in licence_rows()] + [r.text for r in edges.collect()] + list(SENTENCES.values())
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    want = duckdb.connect().sql(oracle_sql()).fetchall()  # reads ``documents``
    found = scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = [(r.doc_id, *(" ".join(c) for c in (r.sentence_ids, r.licences, r.left_over)), "; ".join(r.expressions)) for r in found]
    assert len(documents) == len(got) and sorted(got) == sorted(want)


def test_licences_on_documents_match_plain_search(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plain = {"MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0.", "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0."}
    want = {r.doc_id: sorted(k for k, v in plain.items() if v in (r.text or "")) for r in docs.collect()}
    assert {r.doc_id: r.licences for r in scan(docs).collect()} == want


def test_tasks_that_score_grow_with_the_chunks(spark):
    """Counts of a task's chunks are in memory together, so few shuffle partitions must not gather many chunks."""
    docs = spark.range(80).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 17).cast("string")) for k in range(1, 30)]).alias("text"))
    got = score_texts(docs, bucket_bytes=100).select("doc_id", F.spark_partition_id().alias("p")).collect()
    assert len({r.doc_id for r in got}) == 80 and len({r.p for r in got}) > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_round_of_training_opens_its_own_files(spark, monkeypatch):
    """All rounds together open each stored chunk once."""
    from pyspark.sql.readwriter import DataFrameReader

    opened, plain = [], DataFrameReader.parquet
    monkeypatch.setattr(DataFrameReader, "parquet", lambda self, *paths, **options: opened.append([p for p in paths if p.endswith(".parquet")]) or plain(self, *paths, **options))
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit(" w"), "id"), 30).alias("text"))
    assert score_texts(docs, bucket_bytes=100).count() == 40
    rounds = [paths for paths in opened if paths]
    assert len(rounds) >= 4 and len(set(sum(rounds, []))) == len(sum(rounds, []))
