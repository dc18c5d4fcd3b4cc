"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

Only lines that occur twice or more can be part of a repeated run; the others
cut a document into islands. Suffixes of islands are ranked by their first 1,
2, 4, ... lines: each round joins a suffix's rank with that of the suffix as
many lines further on, counts the distinct pairs, and numbers these in order.
A suffix whose rank no other shares has no copy and leaves the ranking.

Two ranks name the longest-common-prefix interval of any depth: the suffixes
that share their first n lines. A line lies in a repeated run of ``min_words``
words exactly if it lies in a shortest such run that starts or ends with one of
the run's lines, so these windows, one or two for each line, find every maximal
run in full: of the windows in one interval all but the first go. Windows have
no more lines than ``min_words``, which is how deep the ranking has to go.

A window goes only if its interval's first copy ends before it begins. In a list
whose lines repeat each other the windows that overlap their first copy stay,
so that copy stays whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cladewise.llm.common import RID, P, materialise, number_rows, table, with_row_ids
from cladewise.sources.shared import release

MIN_WORDS = 50
#: Words of 64 bits in the filter of documents that lose lines: fixed, so its broadcast is bounded. With more such documents more others pass it, and are joined for nothing.
FILTER_WORDS = 1 << 18
_BLANK = " \t\n\x0b\f\r"


def _join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the corpus, planned alike at every size."""
    return left.join(right.hint("merge"), on, how)


def islands(lines: DataFrame, min_words: int) -> DataFrame:
    """Repeated lines of islands of ``min_words`` words or more, in order.

    ``p`` (number of the line, consecutive within an island), ``rank`` (of the
    line; equal lines, equal ranks), ``rest`` (lines to the island's end),
    ``ahead`` and ``back`` (lines of the shortest run of ``min_words`` words
    that starts or ends here; null where the island does not hold it).
    """
    repeated = lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ids = number_rows(repeated, [F.asc("h1"), F.asc("h2")], "rank", F.col("n")).select("h1", "h2", "rank")
    active = materialise(_join(lines, materialise(ids), ["h1", "h2"]).select(RID, "id", "k", "no", "words", "rank"))
    doc = Window.partitionBy(RID).orderBy("k")
    isle = Window.partitionBy(RID, "island")
    placed = active.withColumn("island", F.col("k") - F.row_number().over(doc))
    upto = F.sum("words").over(isle.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("after", upto).withColumn("before", F.col("after") - F.col("words"))
    placed = placed.withColumn("whole", F.max("after").over(isle)).withColumn("rest", F.max("k").over(isle) - F.col("k") + 1)
    # every line has a word at least, so both are positions in the order of lines
    ahead = F.count(F.lit(1)).over(isle.orderBy("before").rangeBetween(0, min_words - 1))
    back = F.count(F.lit(1)).over(isle.orderBy("after").rangeBetween(1 - min_words, 0))
    placed = placed.where(F.col("whole") >= min_words)
    placed = placed.withColumn("ahead", F.when(F.col("whole") - F.col("before") >= min_words, ahead)).withColumn("back", F.when(F.col("after") >= min_words, back))
    kept = placed.select(RID, "id", "k", "no", "words", "island", "rank", F.col("rest").cast("int").alias("rest"), F.col("ahead").cast("int").alias("ahead"), F.col("back").cast("int").alias("back"))
    out = materialise(number_rows(kept, [F.asc_nulls_last("id"), F.asc(RID), F.asc("k")], "p"))
    release(active)
    return out


def ranks(suffixes: DataFrame, deepest: int) -> list[DataFrame]:
    """Tables ``(p, rank, rest)`` of the suffixes that share their first 2**j lines with others, for each j with 2**j <= ``deepest``.

    Equal ranks, equal lines; the order of ranks is that of the suffixes. From ``suffixes(p, rank, rest)``.
    """
    now, length, out = suffixes.select("p", "rank", "rest"), 1, []
    while True:
        out.append(now)
        if 2 * length > deepest:
            return out
        later = now.select((F.col("p") - length).alias("p"), F.col("rank").alias("next"))
        paired = materialise(_join(now.where(F.col("rest") >= 2 * length), later, ["p"]).select("p", "rank", "next", "rest"))
        pairs = paired.groupBy("rank", "next").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        # stored, so that the join below can split a frequent pair
        named = materialise(number_rows(pairs, [F.asc("rank"), F.asc("next")], "new", F.col("n")).select("rank", "next", "new"))
        now = materialise(_join(paired, named, ["rank", "next"]).select("p", F.col("new").alias("rank"), "rest"))
        release(paired, named)
        length *= 2
        if now.isEmpty():
            return out


def later_runs(suffixes: DataFrame, by_rank: list[DataFrame]) -> DataFrame:
    """``(p, run)``: for each suffix that starts windows with an earlier copy, which ends before they begin, the lines of the longest."""
    ahead = suffixes.select("p", F.col("ahead").alias("n"))
    back = suffixes.select((F.col("p") - F.col("back") + 1).alias("p"), F.col("back").alias("n"))
    windows = ahead.unionByName(back).where("n IS NOT NULL")
    named = None
    for j, level in enumerate(by_rank):
        own = windows.where(f"n >= {1 << j} AND n < {2 << j}").withColumn("q", F.col("p") + F.col("n") - (1 << j))
        own = _join(own, level.select("p", "rank"), ["p"])
        second = level.select(F.col("p").alias("q"), F.col("rank").alias("second"))
        own = (_join(own, second, ["q"]) if j else own.withColumn("second", F.col("rank"))).select("p", "n", "rank", "second")
        named = own if named is None else named.unionByName(own)
    named = materialise(named)
    # stored, so that the join can split a frequent passage
    first = materialise(named.groupBy("n", "rank", "second").agg(F.min("p").alias("f"), F.max("p").alias("l")).where("l - f >= n").drop("l"))
    # places are consecutive within an island and never fewer between islands, so this is the distance in lines
    found = _join(named, first, ["n", "rank", "second"]).where("p - f >= n")
    out = materialise(found.groupBy("p").agg(F.max("n").alias("run")))
    release(named, first, *by_rank[1:])
    return out


def _filter(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """``docs`` with ``maybe``: true for every row whose number is in ``marked``, false for nearly all others, by one bit of a table of fixed size."""
    h = F.xxhash64(F.lit(3), RID)
    word, bit = F.pmod(h, F.lit(FILTER_WORDS)).cast("int"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(3, {RID}), 58) AS int))")
    bits = marked.select(word.alias(P + "w"), bit.alias(P + "b")).groupBy(P + "w").agg(F.bit_or(P + "b").alias(P + "b"))
    known = docs.withColumn(P + "w", word).join(F.broadcast(materialise(bits)), P + "w", "left")
    return known.withColumn("maybe", F.coalesce(F.col(P + "b").bitwiseAND(bit) != 0, F.lit(False))).drop(P + "w", P + "b")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete later copies of repeated line runs of ``min_words`` words or more.

    One row per input row: ``doc_id, text`` (what is left), ``n_lines``,
    ``deleted_lines`` (numbers from 0) and ``deleted_words``. Lines are compared
    without white space around them, by 128 bits of hash; lines without words
    are passed over and stay. A line goes if it lies in a run of lines, of
    ``min_words`` words together, that stands somewhere before, in the order of
    ids (null ids last, then the order of rows, then the place in the text), and
    ends there before the later run begins; copies within a document count, and
    so do copies that go themselves, whose first one stays. A run that overlaps
    its own copy stays as far as they overlap. Runs of fewer words stay whole. Null texts stay null, with
    0 lines; a text without repeated runs stays as it is, however long.
    Repeated rows are copies of each other; extra columns are ignored; an empty
    table gives no rows.
    """
    if min_words < 1:
        raise ValueError("min_words must be 1 or more")
    held = with_row_ids(docs).select(RID, F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    each = F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.struct(F.btrim(s, F.lit(_BLANK)).alias("s"), i.alias("no"))), lambda x: x["s"] != ""))
    lines = held.select(RID, "id", each.alias("k", "line"))
    s = F.col("line.s")
    lines = materialise(lines.select(RID, "id", "k", F.col("line.no").alias("no"), F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(1), s).alias("h2"), F.regexp_count(s, F.lit(r"\S+")).alias("words")))
    suffixes = islands(lines, min_words)
    release(lines)
    runs = later_runs(suffixes, ranks(suffixes, min_words))
    # a line goes if a run that began at or before it in its island reaches beyond it
    upto = F.max(F.col("p") + F.col("run")).over(Window.partitionBy(RID, "island").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    gone = _join(suffixes, runs, ["p"], "left").withColumn("upto", upto).where("upto > p")
    per_doc = materialise(gone.groupBy(RID).agg(F.array_sort(F.collect_list("no")).alias("deleted"), F.sum("words").alias("gone")))
    release(suffixes, runs)
    parts = _filter(held, per_doc.select(RID)).withColumn("parts", F.split("text", "\n"))
    left = parts.where("NOT maybe").select("id", "text", "parts", F.array().cast("array<int>").alias("deleted"), F.lit(0).cast("long").alias("gone"))
    cut = _join(parts.where("maybe"), per_doc, [RID], "left").select("id", "text", "parts", F.coalesce("deleted", F.array().cast("array<int>")).alias("deleted"), F.coalesce("gone", F.lit(0)).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "deleted")  # a set: linear in the lines of a long text
    kept = F.array_join(F.transform(stay, lambda i: F.get("parts", i)), "\n")
    cut = cut.withColumn("text", F.when(F.size("deleted") == 0, F.col("text")).otherwise(kept))
    return left.unionByName(cut).select(
        F.col("id").alias("doc_id"), "text", F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"), F.col("deleted").alias("deleted_lines"), F.col("gone").alias("deleted_words")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))
