"""Fill-in-the-middle transformation of texts.

A text's bytes lie in fixed blocks. A Fenwick tree over the blocks holds how
many units end, and how many code points begin, in the blocks that each of its
nodes covers. Descending by powers of two finds the block in which a cut's unit
ends, with all units and code points before it; only that block is then looked
into. Cuts fall behind white space or words, so never inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import table

BLOCK = 512
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts so many are transformed, and of a hundred of these so many put the suffix first.
RATE, SUFFIX_FIRST, SEED = 50, 80, 42
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_OUTPUT_BYTES = 8 << 20
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class Cuts:
    """Counts of units and code points of one text's blocks, as Fenwick trees."""

    def __init__(self, text: bytes, block: int = BLOCK):
        self.block = block
        raw = np.frombuffer(text, np.uint8)
        space = _SPACE[raw]
        self.ends = ~space
        self.ends[:-1] &= space[1:]
        if len(raw):
            self.ends[-1] = True
        self.starts = (raw & 0xC0) != 0x80
        edges = np.arange(0, len(raw), block)
        counts = np.stack([np.add.reduceat(x, edges, dtype=np.int64) if len(raw) else np.zeros(0, np.int64) for x in (self.ends, self.starts)])
        before = np.pad(counts.cumsum(1), ((0, 0), (1, 0)))
        at = np.arange(before.shape[1])
        tree = before - before[:, at - (at & -at)]
        self.units, self.points = tree[0].tolist(), tree[1].tolist()
        self.n = int(before[0, -1])
        self.top = 1 << (len(self.units) - 1).bit_length() >> 1 if len(self.units) > 1 else 0

    def find(self, k: int) -> tuple[int, int]:
        """Bytes and code points of the first ``k`` units."""
        if k == 0:
            return 0, 0
        block, units, points, step = 0, 0, 0, self.top
        while step:
            there = block + step
            if there < len(self.units) and units + self.units[there] < k:
                block, units, points = there, units + self.units[there], points + self.points[there]
            step >>= 1
        start = block * self.block
        size = int(np.flatnonzero(self.ends[start : start + self.block])[k - units - 1]) + 1
        return start + size, points + int(self.starts[start : start + size].sum())


def _transform(key: str, text: bytes, rate: int, suffix_first: int, seed: int) -> tuple[int, str, int | None, int | None, bytes]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    cuts = Cuts(text)
    if not text or any(mark.encode() in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return cuts.n, "plain", None, None, text
    (a, before), (b, upto) = (cuts.find(k) for k in sorted(x % (cuts.n + 1) for x in h[:2]))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < suffix_first:
        form, parts = "spm", (SUFFIX.encode(), suffix, PREFIX.encode(), prefix, MIDDLE.encode(), middle)
    else:
        form, parts = "psm", (PREFIX.encode(), prefix, SUFFIX.encode(), suffix, MIDDLE.encode(), middle)
    return cuts.n, form, before, upto - before, b"".join(parts)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row; whole texts, whatever their length.

    ``n`` units: words, each with the white space before it, and white space
    at the end. ``form``: ``plain`` (as it was, both counts null), ``psm`` or
    ``spm``. Cuts and form depend on seed and id only, so that repeated rows
    come out alike; a null id counts as an empty one. Null and empty texts, and
    those that hold a mark, stay plain; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, text in zip(batch.column(0), batch.column(1)):
                key, text = key.as_py(), text.as_py()
                found = _transform("" if key is None else str(key), text or b"", rate, suffix_first, seed)
                rows.append((key, *found))
                size += len(found[-1])
                if size >= _OUTPUT_BYTES:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(id_col).cast("long"), F.encode(F.col(text_col), "UTF-8")).mapInArrow(run, _SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, forms, before, between, texts = zip(*rows)
    whole = pa.array([int(i) if i is not None else None for i in ids], pa.int64())
    return pa.RecordBatch.from_arrays([whole, pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(before, pa.int64()), pa.array(between, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restore(output: Column, form: Column) -> Column:
    """Text back from an output and its form; marks stand once each in outputs that are not plain."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


_UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
OP12_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hex, regexp_extract_all(coalesce(text, ''), '{_UNITS}') AS u FROM documents),
h AS (SELECT *, len(u) AS n, CAST('0x' || hex[1:8] AS BIGINT) AS h1, CAST('0x' || hex[9:16] AS BIGINT) AS h2, CAST('0x' || hex[17:24] AS BIGINT) AS h3, CAST('0x' || hex[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1 : b], '') AS mid, array_to_string(u[b + 1 :], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
