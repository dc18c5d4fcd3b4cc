"""Merkle manifest of a table, a tree for each language and one over their roots, with a proof for every row.

Levels are built by grouped sums of a fixed number of hashes. Proofs come by
pointer jumping: each node starts with the sibling segment towards its parent;
a self-join gives it the segment of the node it points to and that node's
pointer, so that the distance doubles in each round, until all point past the
root. Only nodes above the leaves jump; a leaf takes the path of its run last,
and so its own row never moves with a long path.

A target of the k-th round lies 2**k levels up, so there are at most 1/8**(2**k)
as many targets as nodes; they are stored by themselves, and Spark broadcasts
them only below its size limit. Beyond it there are far too many of them for one to be hot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import number_rows, table
from cladewise.sources.shared import release, stored

BRANCH = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_TOP = -1
_STEP = "array<struct<place:int,others:string>>"


def leaf_hash(*fields: Column) -> Column:
    """Hash of a row's fields, each with its length in bytes; null is a dash."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def _joined(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda m: m["h"]), "")


def _others(members: str, place: Column) -> Column:
    return _joined(F.filter(members, lambda m: m["place"] != place))


def _climb(nodes: DataFrame, level: int) -> tuple[DataFrame, DataFrame | None, int]:
    """Trees above ``nodes(tree, pos, n, h, key)``: their roots, the edges ``key, up, path`` to each node's parent, and the highest level.

    A run's hash is that of its nodes' hashes; a tree with one node left is done.
    """
    columns = ["tree", "pos", "n", "h", "key"]
    roots, edges, now = nodes.where("n = 1").select(columns), None, nodes
    place = (F.col("pos") % BRANCH).cast("int").alias("place")
    while True:
        runs = now.where("n > 1").groupBy("tree", F.expr(f"pos div {BRANCH}").alias("pos")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(place, "h", "key"))).alias("members"))
        level += 1
        found = stored(runs.select("tree", "pos", F.expr(f"(n + {BRANCH - 1}) div {BRANCH}").alias("n"), F.sha2(_joined(F.col("members")), 256).alias("h"), F.struct("tree", F.lit(level).alias("level"), "pos").alias("key"), "members"))
        if found.isEmpty():
            return roots, edges, level
        each = found.select(F.col("key").alias("up"), "members", F.explode("members").alias("m"))
        step = F.array(F.struct(F.col("m.place").alias("place"), _others("members", F.col("m.place")).alias("others"))).cast(_STEP)
        child = each.select(F.col("m.key").alias("key"), "up", step.alias("path"))
        edges = child if edges is None else edges.unionByName(child)
        roots = roots.unionByName(found.where("n = 1").select(columns))
        now = found


def _jump(edges: DataFrame) -> DataFrame:
    """``key, path``: each node's sibling segments up to the root, from ``edges(key, up, path)`` by doubling."""
    now, distance = stored(edges), 1
    while not now.where("up IS NOT NULL").isEmpty():
        targets = stored(now.where(F.col("key.level") > distance).select(F.col("key").alias("up"), F.col("up").alias("further"), F.col("path").alias("rest")))
        moving = now.where("up IS NOT NULL").join(targets, "up", "left")
        moved = moving.select("key", F.col("further").alias("up"), F.concat("path", F.coalesce("rest", F.array().cast(_STEP))).alias("path"))
        # nodes that point past the root have no key to join on and stay as they are
        then = stored(now.where("up IS NULL").unionByName(moved))
        release(now, targets)
        now, distance = then, 2 * distance
    return now.select("key", "path")


def proofs(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, leaf, subroot, root, path`` of every row, and the columns named in ``carry``.

    ``path`` has a step for each run on the way from the row to the root: the
    row's or node's ``place`` in it, and the hashes of its ``others``, one after
    the other. In each group (null is one of its own) leaves ascend by id; null
    ids come first, equal ids in the order of their hashes, and repeated rows
    take places of their own. Texts are hashed whole. A table of one row has an
    empty path, and its leaf is the root; an empty table gives no rows. Other columns are ignored.
    """
    extra = F.struct(F.lit(1).alias("_"), *carry).alias("extra")
    held = stored(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf_hash(*[F.col(c) for c in fields]).alias("leaf"), extra, F.monotonically_increasing_id().alias("rid")))
    numbered = number_rows(held, [F.asc_nulls_first("grp"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("rid")], "no")
    groups = stored(number_rows(numbered.groupBy("grp").agg(F.min("no").alias("start"), F.count(F.lit(1)).alias("n")), [F.asc_nulls_first("grp")], "tree").withColumnRenamed("grp", "g"))
    placed = numbered.join(groups, F.col("grp").eqNullSafe(F.col("g"))).withColumn("pos", F.col("no") - F.col("start"))
    member = F.struct((F.col("pos") % BRANCH).cast("int").alias("place"), F.col("leaf").alias("h"), "id", "extra")
    runs = placed.groupBy("tree", F.expr(f"pos div {BRANCH}").alias("pos")).agg(F.first("n").alias("leaves"), F.array_sort(F.collect_list(member)).alias("members"))
    # the only leaf of a group is its subroot itself
    h = F.when(F.col("leaves") > 1, F.sha2(_joined(F.col("members")), 256)).otherwise(F.col("members")[0]["h"])
    base = stored(runs.select("tree", "pos", F.expr(f"(leaves + {BRANCH - 1}) div {BRANCH}").alias("n"), h.alias("h"), F.struct("tree", F.lit(1).alias("level"), "pos").alias("key"), "leaves", "members"))
    release(held)
    subroots, edges, level = _climb(base.select("tree", "pos", "n", "h", "key"), 1)
    subroots = stored(subroots.select("tree", "h", "key"))
    count = subroots.count()
    tops, above, _ = _climb(subroots.select(F.lit(_TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(count).cast("long").alias("n"), "h", "key"), level)
    root = tops.first()  # one row
    every = above if edges is None else edges if above is None else edges.unionByName(above)
    with_path = base.withColumn("path", F.array().cast(_STEP)) if every is None else base.join(_jump(every), "key", "left").withColumn("path", F.coalesce("path", F.array().cast(_STEP)))
    named = with_path.join(subroots.select("tree", F.col("h").alias("subroot")), "tree")
    each = named.select("subroot", "path", "members", "leaves", F.explode("members").alias("m"))
    first = F.array(F.struct(F.col("m.place").alias("place"), _others("members", F.col("m.place")).alias("others"))).cast(_STEP)
    path = F.when(F.col("leaves") > 1, F.concat(first, F.col("path"))).otherwise(F.col("path"))
    whole = F.lit(root["h"] if root else None).cast("string")
    return each.select(F.col("m.id").alias("doc_id"), F.col("m.h").alias("leaf"), "subroot", whole.alias("root"), path.alias("path"), *[F.col(f"m.extra.{c}").alias(c) for c in carry])


def proof_hash(path: Column) -> Column:
    """Hash of all siblings of a path, from the leaf up."""
    return F.sha2(F.array_join(F.transform(path, lambda s: s["others"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """Root that a leaf's hash and its path lead to."""
    def step(h: Column, s: Column) -> Column:
        before = 64 * s["place"]
        return F.sha2(F.concat(F.substring(s["others"], F.lit(1), before), h, F.substring(s["others"], before + 1, F.length(s["others"]))), 256)

    return F.aggregate(path, leaf, step)


def lower_ascii(text: Column) -> Column:
    """Lower case of A-Z alone."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents, and what becomes of them where a third of the texts has been tampered with."""
    docs = table(spark, sf_dir, "documents")
    altered = leaf_hash(*[lower_ascii(F.col("text")) if c == "text" else F.col(c) for c in FIELDS])
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = proofs(docs.withColumn("altered", F.when(chosen, altered)), carry=("altered",))
    folded = found.withColumn("folded_root", fold(F.coalesce("altered", "leaf"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _leaf_sql(text: str) -> str:
    fields = [text if c == "text" else c for c in FIELDS]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in fields) + ")"


_CRC = """list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8))"""
OP11_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
lf AS (SELECT doc_id, row_number() OVER () AS rid, lang, {_leaf_sql('text')} AS leaf,
  CASE WHEN xor({_CRC}, 4294967295) % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered FROM documents CROSS JOIN crc),
pl AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM lf),
lv AS (SELECT tree, pos, n, leaf AS h, 0 AS level FROM pl
  UNION ALL SELECT tree, pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value(level) + 1 FROM lv WHERE n > 1 GROUP BY tree, pos // 8),
sr AS (SELECT tree, h FROM lv WHERE n = 1),
tp AS (SELECT tree AS pos, (SELECT count(*) FROM sr) AS n, h, 0 AS level FROM sr
  UNION ALL SELECT pos // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value(level) + 1 FROM tp WHERE n > 1 GROUP BY pos // 8),
ru AS (SELECT tree, level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM lv WHERE n > 1 GROUP BY ALL),
rt AS (SELECT level, pos // 8 AS run, list(h ORDER BY pos) AS hs FROM tp WHERE n > 1 GROUP BY ALL),
w AS (SELECT rid, tree, pos, n, 0 AS level, coalesce(altered, leaf) AS h, '' AS proof FROM pl
  UNION ALL SELECT w.rid, w.tree, w.pos // 8, (w.n + 7) // 8, w.level + 1, sha256(array_to_string(hs[1 : w.pos % 8], '') || w.h || array_to_string(hs[w.pos % 8 + 2 :], '')), proof || array_to_string(hs[1 : w.pos % 8], '') || array_to_string(hs[w.pos % 8 + 2 :], '')
  FROM w JOIN ru ON ru.tree = w.tree AND ru.level = w.level AND ru.run = w.pos // 8 WHERE w.n > 1),
v AS (SELECT rid, tree AS pos, (SELECT count(*) FROM sr) AS n, 0 AS level, h, proof FROM w WHERE n = 1
  UNION ALL SELECT v.rid, v.pos // 8, (v.n + 7) // 8, v.level + 1, sha256(array_to_string(hs[1 : v.pos % 8], '') || v.h || array_to_string(hs[v.pos % 8 + 2 :], '')), proof || array_to_string(hs[1 : v.pos % 8], '') || array_to_string(hs[v.pos % 8 + 2 :], '')
  FROM v JOIN rt ON rt.level = v.level AND rt.run = v.pos // 8 WHERE v.n > 1)
SELECT pl.doc_id, pl.leaf, sr.h AS subroot, (SELECT h FROM tp WHERE n = 1) AS root, sha256(v.proof) AS proof_sha256, v.h AS folded_root, v.h = (SELECT h FROM tp WHERE n = 1) AS verified
FROM pl JOIN sr ON sr.tree = pl.tree JOIN v ON v.rid = pl.rid WHERE v.n = 1"""
