"""Packing by power-of-two decomposition.

Each document is cut into pieces whose lengths are powers of two, at most the
context length; pieces of equal length form a bucket. A piece is a sequence of
its own, so no sequence crosses documents and none needs padding.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cladewise.llm.common import RID, few_rows, materialise, number_rows, table

CONTEXT, END_ID = 2048, 1
#: Unicode white space; str.split also cuts at the four characters below, which are no white space to the tokenizers.
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_NOT_SPACE_HERE = re.compile("[\x1c-\x1f]")
_CACHED, _CACHED_LENGTH, _WORDS = 600_000, 40, 200_000


class WordIds:
    """Ids of texts as little-endian 32-bit bytes, by a tokenizer that never joins over white space.

    Words are looked up; only words not met yet go through the tokenizer, many
    at a time, without case where the tokenizer has none and without a final
    stop or comma.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.letters: dict[str, tuple[int, str]] = {}
        normal = self.tokenizer.normalizer
        self.no_case = normal is not None and normal.normalize_str("AZ\u00c0\u00de") == "az\u00e0\u00fe"

    def _words(self, text: str) -> list[str]:
        if self.no_case and "<|" not in text and _latin(text):  # special tokens have case
            text = text.lower()
        return text.split() if not _NOT_SPACE_HERE.search(text) else [w for w in _SPACE.split(text) if w]

    def _learn(self, new: set[str]) -> None:
        known, whole, stems, cut_off = self.known, [w for w in ".," if w not in self.known], set(), []
        for w in new:
            stem = w[:-1] if w[-1] in ".," else w
            if self.no_case and stem.isalpha() and stem.islower() and _latin(stem):
                stems.add(stem)
                if stem is not w:
                    cut_off.append(w)
            else:
                whole.append(w)
        fresh = [w for w in stems if w not in known]
        piece, cut_up = self.tokenizer.model.tokenize, self.tokenizer.pre_tokenizer.pre_tokenize_str
        for c in set().union(*fresh).difference(self.letters):
            self.letters[c] = ord(c), "".join(x for x, _ in cut_up(c))
        spelt = dict(self.letters.values())
        for w in fresh:  # each is one piece to the tokenizer: its normal form is itself, and the model comes next
            known[w] = array("I", [t.id for t in piece(w if w.isascii() else w.translate(spelt))]).tobytes()
        if whole:
            known.update((w, np.array(e.ids, dtype="<u4").tobytes()) for w, e in zip(whole, self.tokenizer.encode_batch_fast(whole, add_special_tokens=False)))
        for w in cut_off:
            known[w] = known[w[:-1]] + known[w[-1]]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        words, size = [], 0
        for i, text in enumerate(texts, 1):
            words.append(self._words(text))
            size += len(words[-1])
            if size >= _WORDS or i == len(texts):
                distinct = set().union(*words)
                new = distinct.difference(self.known)
                if len(self.known) + len(new) > _CACHED:
                    self.known = {w: v for w, v in self.known.items() if w in distinct and len(w) <= _CACHED_LENGTH}
                    new = distinct.difference(self.known)
                if new:
                    self._learn(new)
                get = self.known.__getitem__
                yield from [b"".join(map(get, w)) for w in words]
                words, size = [], 0


def _latin(text: str) -> bool:
    """Whether lower case is the same everywhere and nothing is left to compose."""
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def cut(length: int, context: int = CONTEXT) -> list[int]:
    """Lengths of the pieces of a document of ``length`` tokens: whole contexts, then falling powers of two."""
    pieces = [context] * (length // context)
    rest = length % context
    return pieces + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pieces(docs: DataFrame, id_col: str, text_col: str, row_id: str | None, vocabulary: str, context: int, end_id: int) -> DataFrame:
    rid = F.col(row_id).cast("long") if row_id else F.monotonically_increasing_id()
    end = int(end_id).to_bytes(4, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        encoder = WordIds(vocabulary)
        for b in few_rows(batches):
            which, start, length, crc, total = [], [], [], [], []
            for i, ids in enumerate(encoder.encode([t or "" for t in b.column("t").to_pylist()])):
                ids += end
                at = 0
                for n in cut(len(ids) // 4, context):
                    which.append(i)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + n)]))
                    total.append(len(ids) // 4)
                    at += n
            row = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), b.column(RID).take(row), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))], names=["doc_id", RID, "start", "length", "ids_crc32", "doc_tokens"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), rid.alias(RID), F.col(text_col).alias("t"))
    return given.mapInArrow(each, f"doc_id long, {RID} long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None, vocabulary: str | None = None, context: int = CONTEXT, end_id: int = END_ID) -> DataFrame:
    """Pack documents; one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket``.

    A document's tokens are the ids of its text (null: empty) and then
    ``end_id``; so even an empty text has one piece. ``vocabulary`` is a
    tokenizer file whose tokens never cross white space. ``sequence_id`` counts
    from 0 without gaps, bucket by bucket from the longest, then by document id
    (null first), row and place; ``bucket`` is the length of the sequence, and
    ``offset`` always 0. Repeated rows are packed as often as they occur. Extra
    columns are ignored; an empty table gives no rows.
    """
    if context & (context - 1):
        raise ValueError("the context length must be a power of two")
    made = pieces(docs, id_col, text_col, row_id, vocabulary or public_tokenizers.path("word_bpe_49k.json"), context, end_id)
    numbered = number_rows(materialise(made), [F.desc("length"), F.asc("doc_id"), F.asc(RID), F.asc("start")], "sequence_id")
    return numbered.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"), F.col("length").alias("bucket"), RID)


def op9_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).drop(RID)
