"""Quality rules: a hashed word and character n-gram logistic regression, calibrated, against a fixed threshold.

A bounded, documented sample of labelled rows fits the classifier; every document is then scored whole, in Arrow
batches.  Plain counting rules (too few words, too many repeated word windows) come first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aularank.llm.common import free_names, slices, utf8

#: Hashed feature space: words (and word pairs) in the lower half, character 4-grams in the upper half.
BITS = 17
HALF = 1 << (BITS - 1)
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class QualityParams:
    """``sample_per_class``: labelled rows of each class that the fit reads at most (smallest hash of doc_id first).
    ``threshold``: a document is kept if its calibrated probability of good quality is at least this."""

    sample_per_class: int = 1500
    holdout_mod: int = 4
    epochs: int = 12
    rate: float = 0.5
    l2: float = 1e-6
    threshold: float = 0.25  # leans to keeping: rows with noise score far below it


class _Buckets(dict):
    """Word to its hashed feature; emptied when it holds a million words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 1_000_000:
            self.clear()
        self[word] = got = zlib.crc32(word) & (HALF - 1)
        return got


class _Ids(dict):
    """Word to a number of its own within one text."""

    def __missing__(self, word: bytes) -> int:
        self[word] = got = len(self)
        return got


_buckets = _Buckets()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def features(data: bytes, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed feature numbers of one whole text: (words and adjacent pairs, byte 4-grams of the whole text)."""
    one = np.fromiter(map(_buckets.__getitem__, words), np.int64, len(words))
    two = (one[:-1] * 40503 + one[1:] * 2654435761 + 7) & (HALF - 1) if len(one) > 1 else one[:0]
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) >= 4:
        gram = (b[:-3] | b[1:-2] << 8 | b[2:-1] << 16 | b[3:] << 24) * np.uint32(2654435761)
        chars = (gram >> np.uint32(32 - (BITS - 1))).astype(np.int64) + HALF
    else:
        chars = np.zeros(0, np.int64)
    return np.concatenate([one, two]), chars


def counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    b = np.frombuffer(data, np.uint8)
    chars = int(((b & 0xC0) != 0x80).sum() - ((b == 32) | ((b >= 9) & (b <= 13))).sum()) if len(b) else 0
    seen: set[bytes] = set()
    dup = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    n, repeat = len(words), 0
    if n > 3:
        ids = _Ids()
        x = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        k = len(ids)
        pair, inverse = np.unique(x[:-1] * k + x[1:], return_inverse=True)  # the pair's number keeps three words exact
        window = inverse[:-1].astype(np.int64) * k + x[2:]
        _, where, times = np.unique(window, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[where] > 1)
        covered = np.zeros(n, bool)
        for d in range(3):
            covered[twice + d] = True
        repeat = int(covered.sum())
    return n, chars, int(_SYMBOL[b].sum()) if len(b) else 0, dup, repeat


@dataclass(frozen=True)
class QualityModel:
    """Fitted weights; ``weights`` None keeps every text that the counting rules pass (no labels to learn from)."""

    weights: np.ndarray | None
    bias: float
    slope: float  # calibration: p = sigmoid(slope * margin + shift)
    shift: float
    threshold: float

    def margin(self, words: np.ndarray, chars: np.ndarray) -> float:
        w = self.weights
        return self.bias + (float(w[words].mean()) if len(words) else 0.0) + (float(w[chars].mean()) if len(chars) else 0.0)

    def probability(self, words: np.ndarray, chars: np.ndarray) -> float:
        if self.weights is None:
            return 1.0
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(words, chars) + self.shift, -40, 40))))


def labelled_sample(docs: DataFrame, labels: DataFrame, p: QualityParams) -> DataFrame:
    """(label, fold, f, v): at most ``sample_per_class`` labelled texts of each class as hashed feature means."""
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("label"))
    rows = rows.select("doc_id", (F.col("label") > 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    picked = [rows.where(F.col("label") == c).orderBy("h", "doc_id").limit(p.sample_per_class) for c in (0, 1)]
    ids = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * sample_per_class rows of three numbers
    # repeated ids: one text each, before features are made
    texts = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            label = part.column(part.schema.get_field_index("label"))
            h = part.column(part.schema.get_field_index("h"))
            f, v = [], []
            for data in utf8(part, "text"):
                fs, vs = [], []
                for own in features(data, data.split()):
                    at, times = np.unique(own, return_counts=True)
                    fs.append(at)
                    vs.append(times / max(1, len(own)))
                f.append(np.concatenate(fs).astype(np.int32).tobytes())
                v.append(np.concatenate(vs).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([label, h, pa.array(f, pa.binary()), pa.array(v, pa.binary())], ["label", "h", "f", "v"])

    return texts.select("label", "h", "text").mapInArrow(run, "label int, h long, f binary, v binary")


def _calibrate(z: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt scaling: Newton steps, halved until the loss falls."""
    def loss(ab: np.ndarray) -> float:
        m = ab[0] * z + ab[1]
        return float((np.logaddexp(0, m) - t * m).sum()) + 1e-6 * float(ab @ ab)

    ab = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(ab[0] * z + ab[1], -30, 30)))
        s = q * (1 - q)
        g = np.array([((q - t) * z).sum(), (q - t).sum()]) + 2e-6 * ab
        hess = np.array([[(s * z * z).sum(), (s * z).sum()], [(s * z).sum(), s.sum()]]) + np.eye(2) * 1e-4
        step, scale, now = np.linalg.solve(hess, g), 1.0, loss(ab)
        while scale > 1e-6 and loss(ab - scale * step) > now:
            scale /= 2
        ab = ab - scale * step
        if np.abs(scale * step).max() < 1e-7:
            break
    return (float(ab[0]), float(ab[1])) if ab[0] > 0 else (1.0, 0.0)


def fit(docs: DataFrame, labels: DataFrame, p: QualityParams = QualityParams()) -> QualityModel:
    """Fits on the bounded sample (AdaGrad over single rows), then calibrates by Platt scaling on its held-out fold."""
    rows = labelled_sample(docs, labels, p).collect()  # bounded: 2 * sample_per_class sparse rows
    rows.sort(key=lambda r: (r["h"], r["label"]))
    data = [(r["label"], i % p.holdout_mod == 0, np.frombuffer(r["f"], np.int32), np.frombuffer(r["v"], np.float32)) for i, r in enumerate(rows)]
    if len({x[0] for x in data}) < 2:
        return QualityModel(None, 0.0, 1.0, 0.0, p.threshold)
    w, g2, bias, b2 = np.zeros(1 << BITS, np.float64), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    train = [x for x in data if not x[1]] or data
    share = sum(x[0] for x in train) / len(train)
    weight = (0.5 / max(1 - share, 1e-9), 0.5 / max(share, 1e-9))  # both classes count alike
    order = np.random.default_rng(7)
    for _ in range(p.epochs):
        for i in order.permutation(len(train)):
            label, _, f, v = train[i]
            z = bias + float(w[f] @ v)
            err = weight[label] * (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - label)
            grad = err * v + p.l2 * w[f]
            g2[f] += grad * grad
            w[f] -= p.rate * grad / np.sqrt(g2[f])
            b2 += err * err
            bias -= p.rate * err / np.sqrt(b2)
    held = [x for x in data if x[1]] or data
    z = np.array([bias + float(w[f] @ v) for _, _, f, v in held])
    y = np.array([x[0] for x in held], float)
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's smoothed targets
    slope, shift = _calibrate(z, t)
    return QualityModel(w.astype(np.float32), bias, slope, shift, p.threshold)


COLUMNS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
           ("base_failed", "boolean"), ("quality", "double"), ("kept", "boolean")]


def judge(docs: DataFrame, model: QualityModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default) of every row, and the columns of ``COLUMNS``.

    A null or empty text has no words, so it fails the base rules; very long texts are counted whole; repeated
    rows are judged row by row; a carried column with the name of a result column keeps its place under
    leading underscores, as many as make its name free; an empty table gives an empty one.
    """
    carry = docs.columns if carry is None else carry
    names = free_names(carry, [n for n, _ in COLUMNS])
    inner = [f"c{k}" for k in range(len(carry))]
    source = docs.select(*[F.col(f"`{n}`").alias(m) for n, m in zip(carry, inner)], F.col(f"`{text}`").cast("string").alias("text__"))
    cell = docs.sparkSession.sparkContext.broadcast(astuple(model))  # 2**BITS float32 at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = QualityModel(*cell.value)
        for part in slices(batches, "text__"):
            out: list[list] = [[] for _ in COLUMNS]
            for data in utf8(part, "text__"):
                words = data.split()
                n = counts(data, words)
                failed = n[0] < MIN_WORDS or 100 * n[4] > MAX_REPEAT_PERCENT * n[0]
                p = m.probability(*features(data, words))
                for column, x in zip(out, (*n, failed, p, not failed and p >= m.threshold)):
                    column.append(x)
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(inner))] + [pa.array(c, kinds[k]) for c, (_, k) in zip(out, COLUMNS)],
                                             inner + [n for n, _ in COLUMNS])

    fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]]
    schema = T.StructType(fields + [T.StructField(n, {"long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType()}[k]) for n, k in COLUMNS])
    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(i).alias(n) for i, n in zip(inner, names)], *[n for n, _ in COLUMNS])


def quality_rules(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), carry: list[str] | None = None) -> DataFrame:
    """Fits on ``labels`` (doc_id, quality) and judges every row of ``docs``; see ``judge`` for odd input."""
    return judge(docs, fit(docs, labels, params), carry=carry)
