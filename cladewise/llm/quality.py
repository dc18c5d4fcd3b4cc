"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text are all that the model sees: it
minimises the non-negative unbiased risk, with the share of good text among the
unlabelled ("class prior") estimated from the same two sets. Documents with the
label 0 are never used as negatives. The unlabelled set is every document of the
learning folds: its part of the prior and of the risk is summed over all of
them in passes of Spark; only the trusted positives are bounded.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm.common import RID, few_rows, table

THRESHOLD, FOLDS, MAX_FIT, PASSES, SEED = 0.3, 5, 8000, 3, 11
_FIXED, DECAY = 1 << 24, 0.003
#: Byte classes: other, lower case, upper case, digit, blank, line end, then single marks, groups of marks, and the two kinds of UTF-8 bytes above 127.
_GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n", b".", b",", b"!?", b"|", b"#$%&*@^~", b"\"'`", b"()[]{}<>", b"-_+=/\\", b":;", bytes(range(128, 192)), bytes(range(192, 256))]
CLASSES = len(_GROUPS) + 1
_CODE = np.zeros(256, np.uint8)
for _i, _g in enumerate(_GROUPS, 1):
    _CODE[list(_g)] = _i
WIDTH = CLASSES * CLASSES + CLASSES + 7
_STEP = 1 << 22


def features(text: str | None) -> np.ndarray:
    """Shape of the whole text: square roots of the shares of byte classes and of their pairs, and a few lengths and repeats."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(WIDTH, np.float32)
    if not raw:
        return out
    pairs, single = np.zeros(CLASSES * CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for at in range(0, len(raw), _STEP):
        code = _CODE[np.frombuffer(raw, np.uint8, count=min(_STEP + 1, len(raw) - at), offset=at)].astype(np.intp)
        single += np.bincount(code[:_STEP], minlength=CLASSES)
        pairs += np.bincount(code[:-1] * CLASSES + code[1:], minlength=CLASSES * CLASSES)
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    out[: CLASSES * CLASSES] = np.sqrt(pairs / max(1, len(raw) - 1))
    out[CLASSES * CLASSES : CLASSES * CLASSES + CLASSES] = np.sqrt(single / len(raw))
    again = sum(map(operator.eq, words, words[1:])) / n
    out[-7:] = [np.sqrt(again), np.log1p(len(words)) / 10, min(40.0, (len(raw) - len(words)) / n) / 10, len(set(words)) / n, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)) / 10, np.log1p(max(map(len, words), default=0)) / 10]
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale).clip(-8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-z.clip(-30, 30)))


def _descend(x: np.ndarray, grad, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam on a linear model over rows that end with a 1; the last entry is the bias."""
    w, m, v = np.zeros(x.shape[1]), 0.0, 0.0
    for t in range(1, steps + 1):
        g = grad(x[:, :-1] @ w[:-1] + w[-1]) @ x + decay * np.r_[w[:-1], 0.0]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


def estimate_prior(positive: np.ndarray, above: np.ndarray, total: int, cuts: np.ndarray, margin: float = 0.1) -> float:
    """Share of positives among unlabelled rows, of which ``above[i]`` of ``total`` score ``cuts[i]`` or more; ``positive`` are scores of positives that the scorer was not fitted on.

    Above any threshold the unlabelled rows hold at least the positives' own
    part; the least ratio of the two upper tails bounds the share from above,
    and confidence margins keep thin tails from being chosen.
    """
    if not len(positive) or not total:
        return 0.5
    p, u = (positive[:, None] >= cuts).mean(0), above / total
    slack = np.sqrt(np.log(4 / margin) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(total))
    usable = p > 0
    best = np.argmin(np.where(usable, (u + slack) / np.where(usable, p, 1), np.inf))
    return float(np.clip(u[best] / max(p[best], 1e-9), 0.05, 0.98))


def _extended(x: np.ndarray, model: Model) -> np.ndarray:
    """Standard features and a 1 for the bias."""
    return np.c_[((x - model.mean) / model.scale).clip(-8, 8), np.ones(len(x))]


def _spread(positive: np.ndarray, sample: np.ndarray, block: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each column over the rows of both, a few columns at a time."""
    mean, deviation = np.zeros(sample.shape[1]), np.zeros(sample.shape[1])
    for at in range(0, len(mean), block):
        some = np.r_[positive[:, at : at + block], sample[:, at : at + block]].astype(float)
        mean[at : at + block], deviation[at : at + block] = some.mean(0), some.std(0)
    return mean, deviation


def tails(x: np.ndarray, model: Model, cuts: np.ndarray) -> np.ndarray:
    """How many rows score each cut or more, and their number."""
    z = _extended(x, model) @ np.r_[model.weight, model.bias]
    return np.r_[len(z) - np.searchsorted(np.sort(z), cuts, side="left"), len(z)].astype(float)


def as_negatives(x: np.ndarray, model: Model) -> np.ndarray:
    """Sums over rows of the slope of the loss of calling a row negative, of that loss, and their number."""
    e = _extended(x, model)
    z = e @ np.r_[model.weight, model.bias]
    return np.r_[_sigmoid(z) @ e, np.logaddexp(0, z).sum(), len(z)]


def fit(positive: np.ndarray, sample: np.ndarray, over_all, steps: int = 200, rate: float = 0.05, decay: float = DECAY, passes: int = PASSES) -> Model:
    """Fit by the non-negative unbiased risk with the logistic loss.

    ``over_all(f)`` sums ``f(features)`` over all unlabelled rows. ``sample``,
    some of these, gives the scale of the features, a first scorer and the
    curvature for the steps; the prior and every step's slope come from all.
    With this loss the unbiased risk is convex: few steps reach its least value.
    Without positives or without unlabelled rows the model gives 0.5 throughout.
    """
    width = max(positive.shape[1], sample.shape[1])
    if not len(positive) or not len(sample):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    mean, deviation = _spread(positive, sample)
    model = Model(mean, deviation + 0.02, np.zeros(width), 0.0, 0.5)
    # the one large table here: this runs on the driver, where memory is short
    both, n = np.ones((len(positive) + len(sample), width + 1)), len(positive)
    some = both[:, :-1]
    some[:n], some[n:] = positive, sample
    some -= model.mean
    some /= model.scale
    np.clip(some, -8, 8, out=some)
    pos, unl = both[:n], both[n:]
    # a plain positive-or-unlabelled model on the even rows, its scores on the odd positives
    y = np.r_[np.ones(len(pos[::2])), np.zeros(len(unl[::2]))]
    balance = np.where(y == 1, 0.5 / len(pos[::2]), 0.5 / max(1, len(unl[::2])))
    w = _descend(np.r_[pos[::2], unl[::2]], lambda z: 2 * balance * (_sigmoid(z) - y), steps, rate, 1e-3)
    model.weight, model.bias = w[:-1], float(w[-1])
    kept = (pos[1::2] if len(pos) > 1 else pos) @ w
    cuts = np.unique(np.quantile(kept, np.linspace(0, 0.98, 99)))
    found = over_all(lambda rows: tails(rows, model, cuts))
    model.prior = estimate_prior(kept, found[:-1], int(found[-1]), cuts)
    # the sample's own least risk first, from which the steps over all rows start
    def slope(z: np.ndarray) -> np.ndarray:
        g, s = np.r_[-model.prior * _sigmoid(z[:n]) / n, _sigmoid(z[n:]) / len(unl)], _sigmoid(z[:n]) - 1
        if np.logaddexp(0, z[n:]).mean() < model.prior * np.logaddexp(0, z[:n]).mean():
            return -g  # the estimate of the negatives' risk went below zero: step back along it
        g[:n] += model.prior * s / n
        return g

    w = _descend(both, slope, 2 * steps, rate, decay)
    for _ in range(passes):
        model.weight, model.bias = w[:-1], float(w[-1])
        found = over_all(lambda rows: as_negatives(rows, model))
        z, v, total = pos @ w, unl @ w, found[-1]
        if not total or found[-2] / total < model.prior * np.logaddexp(0, z).mean():
            break  # the negatives' risk over all rows is below zero: no step from here lowers a risk that counts
        g = found[:-2] / total - model.prior * pos.mean(0) + decay * np.r_[w[:-1], 0.0]
        curve = (unl * (_sigmoid(v) * (1 - _sigmoid(v)))[:, None]).T @ unl / len(unl) + decay * np.diag(np.r_[np.ones(width), 1e-3])
        step = np.linalg.solve(curve, g)
        w = w - step * min(1.0, 1.0 / max(1e-9, np.abs(step).max()))
    model.weight, model.bias = w[:-1], float(w[-1])
    return model


def _fold(id_col: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % folds


def _sampled(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with the given ids (a bounded number), in the order of ids. Of rows with one id that with the least hash of the text counts, so repeats of an id stay bounded too."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            found = [features(t).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, pa.binary())], names=["id", "x"])

    one = docs.join(F.broadcast(ids), "id").groupBy("id").agg(F.min_by("t", F.struct(F.xxhash64("t"), "t")).alias("t"))
    rows = sorted(one.mapInArrow(each, "id long, x binary").collect())
    return np.array([np.frombuffer(r["x"], np.float32) for r in rows]).reshape(-1, WIDTH)


def _summed(texts: DataFrame):
    """``over_all`` of :func:`fit` for the rows ``texts(t)``: a job for each call, whose tasks give whole numbers, so their order does not matter."""

    def over_all(f) -> np.ndarray:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in few_rows(batches):
                found = f(np.array([features(t) for t in b.column("t").to_pylist()]))
                found = np.rint(found * _FIXED).astype(np.int64)
                total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.int64()))], names=["s"])

        sums = texts.mapInArrow(each, "s array<long>").select(F.posexplode("s")).groupBy("pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
        found = {r["pos"]: float(r["s"]) / _FIXED for r in sums.collect()}  # one row for each weight
        return np.array([found[i] for i in range(len(found))]) if found else np.zeros(2 + WIDTH + 1)

    return over_all


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, max_fit: int = MAX_FIT, seed: int = SEED) -> Model:
    """Fit on the rows outside fold 0: at most ``max_fit`` trusted positives, chosen by a hash of the id, and all documents as unlabelled ones, of which ``max_fit`` give the start.

    An id is a trusted positive if all its labels are 1; of several rows with
    one id one counts as positive, all as unlabelled. Null ids take no part;
    null texts are empty; texts are read whole, however long. Repeated rows
    count as often as they occur among the unlabelled. Extra columns are
    ignored. Without documents or without labels the model gives 0.5.
    """
    learn = _fold(F.col("id"), folds) != 0
    chosen = [F.xxhash64(F.lit(seed), "id"), F.col("id")]
    ids = labels.select(F.col(id_col).alias("id"), "quality").where(F.col("id").isNotNull() & F.col("quality").isNotNull() & learn)
    trusted = ids.groupBy("id").agg(F.min("quality").alias("q")).where("q = 1").select("id").orderBy(*chosen).limit(max_fit)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"))
    web = texts.where(F.col("id").isNotNull() & learn)
    some = web.select("id").distinct().orderBy(*chosen).limit(max_fit)
    return fit(_sampled(texts, trusted.select(F.col("id").cast("long"))), _sampled(texts, some), _summed(web.select("t")))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", row_id: str | None = None, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` and the row's number (null without ``row_id``), one row per input row.

    Scores read the whole text, however long, and nothing else; null counts as
    empty, and empty texts get the score of the all-zero features. Rows with a
    null id are in fold 0. Equal texts have equal scores, repeated rows each
    their own row. Extra columns are ignored; an empty table gives no rows.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            found = model.score(np.array([features(t) for t in b.column("t").to_pylist()]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column(RID), pa.array(found, pa.float64())], names=["id", RID, "score"])

    rid = F.col(row_id).cast("long") if row_id else F.lit(None).cast("long")
    given = docs.select(F.col(id_col).cast("long").alias("id"), rid.alias(RID), F.col(text_col).alias("t"))
    scored = given.mapInArrow(each, f"id long, {RID} long, score double")
    return scored.select(F.col("id").alias("doc_id"), (_fold(F.col("id"), folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), RID)


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model predicts to be good, with the columns of ``docs``, in one pass.

    Null and empty texts stay if the all-zero features score well enough; equal
    texts and repeated rows stay or go together; an empty table stays empty.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            good = model.score(np.array([features(t) for t in b.column(text_col).to_pylist()])) >= threshold
            yield b.filter(pa.array(good))

    return docs.mapInArrow(each, docs.schema)


def op2_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels"))).drop(RID)
