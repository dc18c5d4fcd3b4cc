"""Readers of the domain's text formats, as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``path, no, value``: lines in order within their file.

    A file is read whole only where its lines must stay together; these formats are small headers or matrices of one data set each.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return text.select("path", F.posexplode(F.split("value", "\r?\n")).alias("no", "value"))


def barcodes(spark: SparkSession, path: str) -> DataFrame:
    """Mutation table: a head line whose first cell is ignored, then a cell name and an integer for each site. ``path, row, cell, site, state``.

    Rows of another length or with other than integers are an error.
    """
    cells = _lines(spark, path).where(F.trim("value") != "").withColumn("f", F.split(F.trim("value"), r"\s+"))
    head = cells.where("no = 0").select("path", F.slice("f", 2, 1_000_000).alias("sites"))
    rows = cells.where("no > 0").join(head, "path")
    wrong = F.size("f") != F.size("sites") + 1
    checked = rows.withColumn("f", F.when(wrong, F.raise_error(F.concat(F.lit("row of another length: line "), (F.col("no") + 1).cast("string")))).otherwise(F.col("f")))
    value = F.col("v").cast("int")
    return checked.select("path", F.col("no").alias("row"), F.col("f")[0].alias("cell"), "sites", F.posexplode(F.slice("f", 2, 1_000_000)).alias("k", "v")).select("path", "row", "cell", F.expr("sites[k]").alias("site"), value.alias("state"))


def cell_states(spark: SparkSession, path: str) -> DataFrame:
    """``cell, state`` from two comma-separated columns without a head; lines that start with # are comments."""
    rows = spark.read.csv(path, comment="#", schema="cell string, state string, more string", mode="PERMISSIVE")
    ok = F.col("more").isNull() & F.col("state").isNotNull()
    return rows.select(F.when(ok, F.trim("cell")).otherwise(F.raise_error(F.lit("a line has not two columns"))).alias("cell"), F.trim("state").alias("state"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxon, sequence``; a sequence may run over lines. Entries are the records that Spark reads, so a file of any size is cut between them and read by many tasks."""
    entries = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>", "").alias("value"))
    parts = entries.where(F.trim("value") != "").withColumn("f", F.split("value", "\r?\n", 2))
    body = F.upper(F.regexp_replace(F.coalesce(F.get("f", F.lit(1)), F.lit("")), r"\s+", ""))
    return parts.select("path", F.regexp_extract(F.col("f")[0], r"^\s*(\S*)", 1).alias("taxon"), body.alias("sequence"))


def phylip(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxon, sequence`` from PHYLIP: counts of taxa and sites, then names and sequences.

    Lines may be interleaved (a part of each taxon, then the next part of each)
    or sequential (all lines of a taxon, then the next taxon's); what gives every taxon as
    many sites as the head says is taken, interleaved first. Where neither does, it is an error.
    """
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines"))
    head = F.split(F.trim(F.col("lines")[0]), r"\s+")
    rows = text.where(F.size("lines") > 0).select("path", head[0].cast("int").alias("n"), head[1].cast("int").alias("sites"), F.expr("slice(lines, 2, size(lines))").alias("body"))
    rows = rows.withColumn("deep", F.ceil(F.size("body") / F.col("n")).cast("int"))
    clean = lambda x: F.upper(F.regexp_replace(x, r"\s+", ""))

    def taxa(first, more):
        def one(i):
            f = F.split(F.trim(F.get("body", first(i))), r"\s+", 2)
            rest = F.array_join(F.transform(F.filter("body", lambda _, k: more(i, k)), clean), "")
            return F.struct(f[0].alias("taxon"), F.concat(clean(F.coalesce(F.get(f, F.lit(1)), F.lit(""))), rest).alias("sequence"))

        return F.transform(F.sequence(F.lit(0), F.col("n") - 1), one)

    n, deep = F.col("n"), F.col("deep")
    interleaved = taxa(lambda i: i, lambda i, k: (k % n == i) & (k >= n))
    sequential = taxa(lambda i: i * deep, lambda i, k: (F.floor(k / deep) == i) & (k % deep != 0))
    fits = lambda c: F.forall(c, lambda x: (F.length(x["sequence"]) == F.col("sites")) & (x["taxon"] != ""))
    both = rows.withColumns({"a": interleaved, "b": sequential})
    error = F.raise_error(F.concat(F.lit("lengths of sequences differ from the head of "), "path"))
    found = F.when(fits(F.col("a")), F.col("a")).when(fits(F.col("b")), F.col("b")).otherwise(error)
    return both.select("path", F.explode(found).alias("t")).select("path", "t.*")


def maf(spark: SparkSession, path: str) -> DataFrame:
    """``path, block, at, source, start, size, strand, sequence`` of the alignment blocks of a MAF file; ``at`` numbers a block's rows.

    Blocks are the records that Spark reads, so a file of any size is cut
    between them and read by many tasks. They are numbered by counts within each cut and sums over the cuts before.
    """
    read = spark.read.option("lineSep", "\na").text(path)
    records = read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("cut"), F.monotonically_increasing_id().alias("no"), F.filter(F.split("value", "\r?\n"), lambda x: x.rlike(r"^s\s")).alias("rows")).where(F.size("rows") > 0)
    before = Window.partitionBy("path").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    cuts = records.groupBy("path", "cut").agg(F.count(F.lit(1)).alias("n")).select("path", "cut", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    block = F.col("before") + F.row_number().over(Window.partitionBy("path", "cut").orderBy("no"))
    rows = records.join(cuts, ["path", "cut"]).withColumn("block", block).select("path", "block", F.posexplode("rows").alias("at", "line")).withColumn("f", F.split("line", r"\s+"))
    return rows.select("path", "block", "at", F.col("f")[1].alias("source"), F.col("f")[2].cast("long").alias("start"), F.col("f")[3].cast("long").alias("size"), F.col("f")[4].alias("strand"), F.upper(F.col("f")[6]).alias("sequence"))


def maf_pieces(blocks: DataFrame) -> DataFrame:
    """``path, chromosome, start, taxon, sequence``: every block of :func:`maf` with every taxon of its file, gaps where a block lacks one.

    A taxon is what a source has before its first dot; of several rows of a
    taxon in a block the first counts. A block's place is that of its first row,
    the reference. Counts of sites and patterns may be summed over pieces; :func:`joined` puts them together.
    """
    named = blocks.withColumn("taxon", F.substring_index("source", ".", 1))
    first = named.where("at = 0").select("path", "block", F.col("source").alias("chromosome"), "start", F.length("sequence").alias("wide"))
    own = named.groupBy("path", "block", "taxon").agg(F.min_by("sequence", "at").alias("sequence"))
    every = first.join(named.select("path", "taxon").distinct(), "path").join(own, ["path", "block", "taxon"], "left")
    return every.select("path", "chromosome", "start", "block", "taxon", F.coalesce("sequence", F.expr("repeat('-', wide)")).alias("sequence"))


def joined(pieces: DataFrame) -> DataFrame:
    """``path, taxon, sequence`` of :func:`maf_pieces` in the order of the reference; a taxon's sequence must fit a row."""
    order = F.array_sort(F.collect_list(F.struct("chromosome", "start", "block", "sequence")))
    return pieces.groupBy("path", "taxon").agg(F.array_join(F.transform(order, lambda x: x["sequence"]), "").alias("sequence"))


def alignment(spark: SparkSession, path: str) -> DataFrame:
    """``path, taxon, sequence`` of FASTA, PHYLIP or MAF files, all of the format that the first line shows; another first line is an error."""
    line = spark.read.text(path).where(F.trim("value") != "").first()
    head = line.value.strip() if line else ""
    if head.startswith(">"):
        return fasta(spark, path)
    if head.startswith(("##maf", "a score", "track")):
        return joined(maf_pieces(maf(spark, path)))
    if re.fullmatch(r"\d+\s+\d+", head):
        return phylip(spark, path)
    raise ValueError(f"{path} begins like no known alignment format")


def codes(sequences: DataFrame, alphabet: str = "ACGT") -> DataFrame:
    """Sequences as the integer codes of their letters; what is not in the alphabet is missing (-1)."""
    places = F.create_map(*[F.lit(x) for i, c in enumerate(alphabet) for x in (c, i)])
    return sequences.withColumn("codes", F.transform(F.split("sequence", ""), lambda c: F.coalesce(F.try_element_at(places, c), F.lit(-1))))


def distance_matrix(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """``ds, i, j, d`` from the upper triangle of a square matrix of numbers; ``ds`` is the file. Names are numbers unless given. A matrix that is not square, or holds other than numbers, is an error."""
    rows = _lines(spark, path).where(F.trim("value") != "")
    at = F.row_number().over(Window.partitionBy("path").orderBy("no")) - 1
    f = F.split(F.trim("value"), r"\s+")
    high = F.count(F.lit(1)).over(Window.partitionBy("path"))
    wrong = (F.size(f) != high) | F.exists(f, lambda v: v.try_cast("double").isNull())
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("no square matrix of numbers: row "), (at + 1).cast("string")))).otherwise(f)
    cells = rows.select("path", at.alias("i"), checked.alias("f")).select("path", "i", F.posexplode("f").alias("j", "v")).where("i < j")
    out = cells.select(F.col("path").alias("ds"), "i", "j", F.col("v").cast("double").alias("d"))
    if names:
        of = F.array(*[F.lit(n) for n in names])
        out = out.withColumns({"i": F.get(of, F.col("i")), "j": F.get(of, F.col("j"))})
    return out


def newick_lines(spark: SparkSession, path: str) -> DataFrame:
    """``tree, newick``: one tree on each line, blank lines skipped; anything else is an error."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("tree"), F.trim("value").alias("newick"))
    return lines.withColumn("newick", F.when(F.col("newick").startswith("("), F.col("newick")).otherwise(F.raise_error(F.lit("a line is no tree"))))
