"""Newick text to edge tables and back, a tree at a time within its row."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES = T.ArrayType(T.StructType([T.StructField("node", T.IntegerType()), T.StructField("parent", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("length", T.DoubleType())]))
_TOKEN = re.compile(r"\s*([(),;]|:[^(),;:]+|[^(),;:]+)")


def parse(text: str) -> list[tuple]:
    """``(node, parent, name, length)`` in pre-order; the root has parent -1."""
    nodes, stack, at = [[0, -1, "", 0.0]], [0], 0
    here = 0
    for token in _TOKEN.findall(text.strip()):
        token = token.strip()
        if token in ("(", ","):
            if token == ",":
                stack.pop()
            here = len(nodes)
            nodes.append([here, stack[-1], "", 0.0])
            stack.append(here)
            at += token == "("
        elif token == ")":
            stack.pop()
            here = stack[-1]
            at -= 1
        elif token == ";":
            break
        elif token[0] == ":":
            nodes[here][3] = float(token[1:].split("[")[0])
        else:
            nodes[here][2] = token.split("[")[0]
    if at or len(stack) != 1:
        raise ValueError(f"unbalanced tree: {text[:80]}")
    return [tuple(n) for n in nodes]


@F.pandas_udf(NODES)
def _parsed(texts: pd.Series) -> pd.Series:
    return texts.map(parse)


def to_edges(trees: DataFrame) -> DataFrame:
    """``tree, node, parent, length`` from ``trees(tree, newick)``; nodes are named, those without a name get ``_`` and their number."""
    nodes = trees.select("tree", F.explode(_parsed("newick")).alias("n")).select("tree", "n.*")
    name = lambda number, given: F.when(given != "", given).otherwise(F.concat(F.lit("_"), number.cast("string")))
    named = nodes.withColumn("label", name(F.col("node"), F.col("name")))
    above = named.select("tree", F.col("node").alias("parent"), F.col("label").alias("above"))
    return named.join(above, ["tree", "parent"], "left").select("tree", F.col("label").alias("node"), F.col("above").alias("parent"), "length")


def write(edges: list[tuple[str, str | None, float]], decimals: int = 6, marks: dict[str, str] | None = None) -> str:
    """Newick text of ``(node, parent, length)``; children in the order of names. Names that start with _ are left out; ``marks`` adds a comment to nodes."""
    below: dict[str | None, list] = {}
    for node, parent, length in sorted(edges, key=lambda e: e[0]):
        below.setdefault(parent, []).append((node, length))
    done: dict[str, str] = {}
    todo = [(n, x, False) for n, x in below.get(None, [])]
    while todo:
        node, length, ready = todo.pop()
        if not ready and node in below:
            todo.append((node, length, True))
            todo += [(n, x, False) for n, x in below[node]]
            continue
        inside = "(" + ",".join(done[n] for n, _ in below[node]) + ")" if node in below else ""
        label = "" if node.startswith("_") else node
        mark = f"[&state={marks[node]}]" if marks and node in marks else ""
        done[node] = f"{inside}{label}{mark}" if (node, length) in below.get(None, []) else f"{inside}{label}{mark}:{length:.{decimals}f}"
    return "".join(done[n] for n, _ in below.get(None, [])) + ";"


def _lines(rows: DataFrame, name: str, line: Callable[[int, list[tuple]], str]) -> DataFrame:
    """``tree, name``: the ``line`` of each tree's rows, which lie together and in order, so that a task goes through them once; only one tree's rows are held."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        done: list[tuple] = []
        for tree, group in groupby(every, key=itemgetter(0)):
            done.append((tree, line(tree, [(node, parent, math.nan if x is None else x, *more) for _, node, parent, x, *more in group])))
            if len(done) == 1000:
                yield _batch(done, name)
                done = []
        if done:
            yield _batch(done, name)

    return rows.repartition(n, "tree").sortWithinPartitions("tree").mapInArrow(each, f"tree long, {name} string")


def _batch(rows: list[tuple], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["tree", name])


def from_edges(trees: DataFrame, decimals: int = 6) -> DataFrame:
    """``tree, newick`` from edge tables."""
    return _lines(trees.select("tree", "node", "parent", "length"), "newick", lambda _, edges: write(edges, decimals))


def nexus(trees: DataFrame, states: DataFrame) -> DataFrame:
    """NEXUS tree lines whose nodes carry their states: ``tree, line``."""
    marked = trees.join(states, ["tree", "node"], "left").select("tree", "node", "parent", "length", "state")

    def line(tree: int, rows: list[tuple]) -> str:
        marks = {node: state for node, _, _, state in rows if state is not None}
        return f"TREE sample_{tree} = [&R] {write([row[:3] for row in rows], 6, marks)}"

    return _lines(marked, "line", line)
