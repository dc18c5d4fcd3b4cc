"""Merkle proofs, fill-in-the-middle and HTML extraction against brute force."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cladewise.llm.fim import Cuts, fill_in_middle, restore
from cladewise.llm.html_blocks import blocks, extract, first_pass, main_text, op13_html_blocks, second_pass
from cladewise.llm.merkle import FIELDS, fold, proof_hash, proofs

from .conftest import LONG, edge_rows

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle -------------------------------------------------------------------


def slow_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def slow_tree(hashes):
    """Root, and each leaf's steps (place, others)."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), list(hashes)
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for leaf, k in enumerate(at):
            run, place = runs[k // 8], k % 8
            steps[leaf].append((place, "".join(run[:place] + run[place + 1 :])))
        at, level = [k // 8 for k in at], [sha("".join(r)) for r in runs]
    return level[0], steps


def slow_proofs(rows):
    """``(id, leaf, subroot, root, path)`` from ``(id, lang, leaf)``."""
    groups: dict = {}
    for i, lang, leaf in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        groups.setdefault(lang, []).append((i, leaf))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: slow_tree([leaf for _, leaf in groups[g]]) for g in order}
    root, above = slow_tree([trees[g][0] for g in order])
    return [(i, leaf, trees[g][0], root, tuple(trees[g][1][k] + above[n])) for n, g in enumerate(order) for k, (i, leaf) in enumerate(groups[g])]


def as_rows(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, tuple((s.place, s.others) for s in r.path)) for r in df.collect())


def test_proofs_edges(edges, nothing):
    names = edges.columns
    rows = [dict(zip(names, r)) for r in edge_rows()]
    want = slow_proofs([(r["doc_id"], r["lang"], slow_leaf([r[f] for f in FIELDS])) for r in rows])
    assert as_rows(proofs(edges)) == Counter(want)
    assert proofs(nothing).count() == 0


@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 1], [9, 70, 1, 8, 520], [1] * 11])
def test_proofs_of_all_heights(spark, sizes):
    rows = [(100 * k + i, None if k == 0 else f"é{k}", f"t{i % 5}") for k, n in enumerate(sizes) for i in range(n)]
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    found = proofs(df, fields=("doc_id", "text"), carry=("text",))
    want = slow_proofs([(i, lang, slow_leaf((i, t))) for i, lang, t in rows])
    assert as_rows(found) == Counter(want)
    checked = found.select((fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"), (fold(F.sha2("text", 256), F.col("path")) != F.col("root")).alias("other"), proof_hash(F.col("path")).alias("p")).collect()
    assert all(r.ok and r.other for r in checked)
    assert Counter(r.p for r in checked) == Counter(sha("".join(o for _, o in w[4])) for w in want)


def test_crc_of_ids_picks_what_python_does(spark):
    got = spark.range(300).where(F.crc32(F.col("id").cast("string")) % 3 == 0)
    assert [r.id for r in got.orderBy("id").collect()] == [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 0]


# --- fill in the middle ---------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def slow_fim(i, text, seed=42, rate=50, suffix_first=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = sha(f"{seed}:{'' if i is None else i}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < suffix_first:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_edges(spark, edges, nothing):
    odd = [(1000 + i, t) for i, t in enumerate(["<P>", "a <S> b", "x<", "< P > <<S", "\U0001f600 é\t\n", " ", "\x1c", LONG + " \n"] * 4)]
    docs = edges.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = [(r[0], r[1]) for r in edge_rows()] + odd
    for rate in (50, 100):
        got = fill_in_middle(docs, rate=rate).withColumn("back", restore(F.col("output"), F.col("form"))).collect()
        assert Counter(tuple(r)[:-1] for r in got) == Counter((i, *slow_fim(i, t, rate=rate)) for i, t in rows)
        assert Counter((r.doc_id, r.back) for r in got) == Counter((i, t or "") for i, t in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_in_middle(nothing).count() == 0


def test_every_cut_of_small_blocks():
    rng = random.Random(1)
    for _ in range(60):
        text = "".join(rng.choice(" \té日a\x1c\nb") for _ in range(rng.randint(0, 60)))
        units = UNIT.findall(text)
        for block in (1, 3, 8, 512):
            cuts = Cuts(text.encode(), block)
            assert cuts.n == len(units)
            for k in range(len(units) + 1):
                part = "".join(units[:k])
                assert cuts.find(k) == (len(part.encode()), len(part))


# --- main text of pages ---------------------------------------------------------

PROSE = "The quick fox of the forest was seen by the people who live in the old house on the hill and it is said that they were all there for the whole of the day with their dogs, and that was that for all of them in the end."


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pages_of_the_tables(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op13_html_blocks(spark, SF).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        inner = re.search("<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]+>", " ", inner)).split()) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_parts_of_a_page():
    page = f"""<html><head><title>t</title></head><body class="home widget"><div id="cookieNotice">{PROSE}</div>
    <header class="site"><a href="/">Home</a> {PROSE}</header><nav><ul><li><a href=a>One</a><li><a href="b">Two</a></ul></nav><aside><p>{PROSE}</aside>
    <article class="post"><header><h1>Short head</h1></header><p>{PROSE}<p>Yes.<div class="ad">{PROSE}</div><p>Zqx &amp; &eacute;&#33; <b>bold</b>
    <script>if (a<b) document.write("<p>no</p>")</script>end.</p><div class="share-buttons">{PROSE}</div><form><label>{PROSE}</label></form><span class="sponsored">{PROSE}</span>
    <p>Last one.</p><section id="comments"><article class="comment"><p>{PROSE}</p></article></section></article><p style="display: none">{PROSE}</p><footer>{PROSE}</footer></body></html>"""
    assert main_text(page) == f"Short head {PROSE} Yes. Zqx & é! bold end. Last one."


def test_rules_without_an_article():
    page = f"<div>Top<p>{PROSE}<p>Short.<p>{PROSE}</div><div><a href=x>{PROSE}</a></div><p>{'zqx wvut ' * 30}<p>Tail.<p>\xa9 {PROSE}"
    assert main_text(page) == f"{PROSE} Short. {PROSE}"
    assert [first_pass(t, links, bad, article) for t, links, bad, article in blocks(page)] == ["short", "good", "short", "good", "bad", "bad", "short", "bad"]


def test_second_pass_inherits():
    out = [False] * 5
    assert second_pass(["short", "good", "short", "near", "bad"], out) == [False, True, True, True, False]
    assert second_pass(["bad", "near", "short", "near", "bad"], out) == [False, False, False, False, False]
    assert second_pass(["bad", "short", "near", "good", "short"], out) == [False, False, True, True, False]
    assert second_pass(["bad", "short", "near", "short", "bad"], [False, True, True, True, False]) == [False, True, True, True, False]
    assert second_pass([], []) == []


def test_broken_pages(spark):
    want = {"": "", "   ": "", "<": "", "<p": "", "<article>The": "The", "<script>x": "", "<!-- x": "", "<article><h1>The</h1><p>The</article>": "The The", "<div class='ad>x</div>": "", "<nav><article><p>Hi": "Hi", "<article>a < b</article>": "a < b"}
    rows = [(i, None, p) for i, p in enumerate(want)] + [(None, "u", None), (None, "u", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = extract(pages).collect()
    assert Counter((r.page_id, r.url, r.text) for r in got) == Counter((i, u, want.get(p, "")) for i, u, p in rows)
    assert extract(pages.where("false")).count() == 0
    deep = "<div>" * 20000 + "<article>" + "<p>x" * 20000 + "</p>" * 20000
    assert main_text(deep) == " ".join(["x"] * 20000)
