"""Tree models as text, and likelihoods under them."""

import pytest
from pyspark.sql import functions as F

from cladewise.operators import newick, pruning
from cladewise.sources import models, readers

TEXT = """ALPHABET: A C G T
ORDER: 0
SUBST_MOD: HKY85
BACKGROUND: 0.3 0.2 0.2 0.3
RATE_MAT:
  -1.2 0.2 0.7 0.3
  0.3 -1.5 0.2 1.0
  1.0 0.2 -1.5 0.3
  0.3 0.7 0.2 -1.2
TREE: ((x:0.1,y:0.2):0.05,z:0.4);
"""


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_read_and_written_again(spark, tmp_path):
    got = models.read(spark, put(tmp_path, "a.mod", TEXT))
    row = got.first()
    assert (row.alphabet, row.kind, row.freqs, row.newick) == ("ACGT", "HKY85", [0.3, 0.2, 0.2, 0.3], "((x:0.1,y:0.2):0.05,z:0.4);")
    assert row.rates[1] == [0.3, -1.5, 0.2, 1.0]
    assert models.parse(models.write(got)).first() == row
    windows = models.read(spark, put(tmp_path, "b.mod", TEXT.replace("\n", "\r\n"))).first()
    assert windows.rates == row.rates and windows.newick == row.newick
    assert models.read(spark, put(tmp_path, "c.mod", TEXT[: TEXT.index("TREE")])).first().newick is None


@pytest.mark.parametrize(("old", "new", "why"), [("ALPHABET: A C G T", "", "no alphabet"), ("ORDER: 0", "ORDER: 1", "higher order"), ("0.3 0.2 0.2 0.3\n", "0.3 0.2\n", "match"), ("-1.2 0.2", "-1.0 0.2", "sum to zero"), ("BACKGROUND: 0.3", "BACKGROUND: x", "numbers")])
def test_what_is_no_model_is_an_error(spark, tmp_path, old, new, why):
    with pytest.raises(Exception, match=why):
        models.read(spark, put(tmp_path, "bad.mod", TEXT.replace(old, new, 1))).collect()


def test_likelihood_under_a_model_equals_that_of_its_parameters(spark, tmp_path):
    got = models.read(spark, put(tmp_path, "a.mod", TEXT)).withColumn("ds", F.lit(1).cast("long"))
    tree = newick.to_edges(got.select(F.col("ds").alias("tree"), "newick")).withColumnRenamed("tree", "ds")
    edges = tree.withColumn("node", F.when(F.col("node").isin("x", "y", "z"), F.concat(F.lit("t"), "node")).otherwise(F.col("node")))
    data = spark.createDataFrame([("x", "ACGTNA"), ("y", "AAGTCA"), ("z", "ACTTCG")], "taxon string, sequence string").withColumn("ds", F.lit(1).cast("long"))
    value = pruning.dna_likelihood(edges, readers.codes(data), "given", given=got.select("ds", "rates", "freqs"), least=0.0).first()
    import numpy as np

    q, f = np.array(got.first().rates), np.array([0.3, 0.2, 0.2, 0.3])

    def p(t):
        w, v = np.linalg.eig(q * t)
        return (v @ np.diag(np.exp(w)) @ np.linalg.inv(v)).real

    own = lambda c: np.eye(4)["ACGT".index(c)] if c in "ACGT" else np.ones(4)
    want = sum(np.log(f @ ((p(0.05) @ ((p(0.1) @ own(x)) * (p(0.2) @ own(y)))) * (p(0.4) @ own(z)))) for x, y, z in zip("ACGTNA", "AAGTCA", "ACTTCG"))
    assert value.sites == 6 and value.log_likelihood == pytest.approx(want, abs=1e-9)


def test_text_of_a_covariance(spark):
    from cladewise.operators import dump

    d = spark.createDataFrame([(1, 0, 1, 2.0), (1, 0, 2, 3.0), (1, 1, 2, 1.5)], "ds long, i long, j long, d double")
    start = spark.createDataFrame([(1, 1, -1.0), (1, 0, 0.0)], "ds long, place int, value double")
    factors = spark.createDataFrame([(1, 0, [0.5, -0.0]), (1, 1, [0.25, 1.0]), (1, 2, [0.0, 2.0])], "ds long, taxon long, r array<double>")
    got = {(r.section, r.row): r.line for r in dump.covariance(d, 5, "LOWR", start, factors=factors).collect()}
    assert got["head", 0] == "LOWR taxa 3 dimensions 5 lambda 1.000000" and got["parameters", 0] == "0.000000 -1.000000"
    assert got["distances", 1] == "2.000000 0.000000 1.500000" and got["factor", 0] == "0.500000 0.000000" and len(got) == 8
    assert dump.covariance(d.limit(0), 5, "DIAG", start).count() == 0
