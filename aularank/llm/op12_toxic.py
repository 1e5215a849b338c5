"""Toxicity: a linear-chain conditional random field tags toxic tokens; its marginals give scores and offending offsets.

Labels are of documents, so tokens of a bounded, documented sample get theirs first: a token of a toxic document is toxic if
its word, or a beginning of it, is far commoner in toxic documents than in others.  The field (word, beginnings,
ending, neighbours; two states) is trained on these tokens.  Every document is then read whole: forward and
backward messages run over all tokens of an Arrow slice at once, in blocks whose matrix products are made side by side.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aularank.llm.common import free_names, slices, utf8

BITS = 18
#: Tokens of a block: a block's steps run one after another, all blocks side by side.
BLOCK = 128
KNOWN_TOKENS = 400_000  # tokens whose weights a task remembers at most
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


@dataclass(frozen=True)
class ToxicParams:
    """``sample_per_class``, ``sample_bytes``: the fit reads at most so many labelled rows of each class (smallest hash of
    doc_id first), from texts of at most so many bytes."""

    sample_per_class: int = 1500
    sample_bytes: int = 16384
    fold_mod: int = 5  # rows whose crc32(doc_id) has remainder 0 are never learned from
    calibrate_mod: int = 3  # every third sampled row fits the aggregation instead of the field
    least_odds: float = 1.8
    least_docs: int = 4
    rounds: int = 60
    rate: float = 0.15
    l2: float = 2e-5
    span: float = 0.5  # a token belongs to a span from this marginal on


def token_features(token: bytes) -> tuple[list[int], int, int]:
    """Hashed numbers of a token: (its own: word, beginnings, ending; as the one before; as the one after)."""
    word = token.decode("utf-8", "replace").lower()
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    word = word[start:end]
    own = ["w" + word, *(f"{k}{word[:k]}" for k in (4, 5, 6, 7, 8) if len(word) > k)]
    if len(word) > 4:
        own.append("s" + word[-4:])
    mask = (1 << BITS) - 1
    return [zlib.crc32(x.encode()) & mask for x in own], zlib.crc32(b"p" + word.encode()) & mask, zlib.crc32(b"n" + word.encode()) & mask


def _times(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Products of 2x2 matrices (00, 01, 10, 11), scaled so that their largest entry is 1."""
    out = [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    top = np.maximum(np.maximum(out[0], out[1]), np.maximum(out[2], out[3]))
    return [x / top for x in out]


def messages(e: np.ndarray, first: np.ndarray, chain: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages, backward messages (both n x 2) and the steps' matrices (n x 4) of texts that stand one after another.

    ``e``: a token's weight for toxic; ``first``: it begins a text; ``chain`` (2 x 2) and ``start`` (2): log weights.  A text's
    first step has equal rows, so that nothing passes from one text into the next.
    """
    n = len(e)
    blocks = -(-n // BLOCK)
    e = np.clip(e, -40, 40)
    t = np.exp(chain)
    scale = np.exp(-np.maximum(e, 0))
    toxic = np.exp(np.minimum(e, 0))  # (scale, toxic) = (1, exp(e)) over their larger
    m = np.tile(np.array([[1.0], [0.0], [0.0], [1.0]]), (1, blocks * BLOCK))
    for k, (i, j) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        m[k, :n] = np.where(first, np.exp(start[j]), t[i, j]) * (toxic if j else scale)
    steps = m.reshape(4, blocks, BLOCK)
    ahead, behind = np.empty((BLOCK, 4, blocks)), np.empty((BLOCK, 4, blocks))
    run: list[np.ndarray] = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for j in range(BLOCK):
        run = _times(run, list(steps[:, :, j]))
        ahead[j] = run
    run = [np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)]
    for j in range(BLOCK - 1, -1, -1):
        behind[j] = run
        run = _times(list(steps[:, :, j]), run)
    whole = np.array(run).T.tolist()
    into, out, a = [], [], (1.0, 1.0)
    for x in whole:
        into.append(a)
        u, v = a[0] * x[0] + a[1] * x[2], a[0] * x[1] + a[1] * x[3]
        a = (u / (u + v), v / (u + v))
    b = (1.0, 1.0)
    for x in reversed(whole):
        out.append(b)
        u, v = x[0] * b[0] + x[1] * b[1], x[2] * b[0] + x[3] * b[1]
        b = (u / (u + v), v / (u + v))
    i, o = np.array(into).T, np.array(out[::-1]).T
    forward = np.stack([i[0] * ahead[:, 0] + i[1] * ahead[:, 2], i[0] * ahead[:, 1] + i[1] * ahead[:, 3]])
    backward = np.stack([behind[:, 0] * o[0] + behind[:, 1] * o[1], behind[:, 2] * o[0] + behind[:, 3] * o[1]])
    forward, backward = (x.transpose(2, 1, 0).reshape(blocks * BLOCK, 2)[:n] for x in (forward, backward))
    return forward / forward.sum(1, keepdims=True), backward / backward.sum(1, keepdims=True), m[:, :n].T


def marginals(e: np.ndarray, first: np.ndarray, chain: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each token's probability of being toxic given its whole text."""
    if not len(e):
        return e
    forward, backward, _ = messages(e, first, chain, start)
    both = forward * backward
    return both[:, 1] / both.sum(1)


def emissions(own: np.ndarray, before: np.ndarray, after: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Token weights: its own, and those that its neighbours in the text lend it."""
    e = own[ids]
    inner = np.flatnonzero(~first)
    e[inner] += before[ids[inner - 1]]
    e[inner - 1] += after[ids[inner]]
    return e


def doc_features(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of each text (its tokens end before ``ends``): log expected toxic tokens, their share, the largest marginal, one."""
    n = np.diff(ends, prepend=0)
    total = np.concatenate([[0.0], np.cumsum(p)])
    held = total[ends] - total[ends - n]
    top = np.zeros(len(ends))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, (ends - n)[some])
    return np.stack([np.log1p(held), held / np.sqrt(np.maximum(n, 1)), top, np.ones(len(ends))], 1)


@dataclass(frozen=True)
class ToxicModel:
    """``weights`` None: no rows of both classes to learn from; every score is then 0."""

    weights: np.ndarray | None
    bias: float
    chain: np.ndarray
    start: np.ndarray
    gather: np.ndarray
    span: float


class _Known(dict):
    """Token to a number; its weights stand in arrays under that number."""

    def __init__(self, model: ToxicModel):
        super().__init__()
        self.model, self.own, self.before, self.after = model, array("d"), array("d"), array("d")

    def __missing__(self, token: bytes) -> int:
        own, before, after = token_features(token)
        w = self.model.weights
        self.own.append(self.model.bias + float(w[own].sum()))
        self.before.append(float(w[before]))
        self.after.append(float(w[after]))
        self[token] = got = len(self.own) - 1
        return got


def sample(docs: DataFrame, labels: DataFrame, p: ToxicParams) -> tuple[list[tuple[int, bytes]], dict[int, int]]:
    """The sampled (label, text) rows, and the number of all rows of each class that may be learned from."""
    rows = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    rows = rows.select("doc_id", (F.col("toxic") > 0).cast("int").alias("label"), F.xxhash64("doc_id").alias("h"))
    rows = rows.where(F.crc32(F.col("doc_id").cast("string")) % p.fold_mod != 0)
    short = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(F.octet_length("text") <= p.sample_bytes)
    ids = short.select("doc_id").distinct().join(rows, "doc_id")
    picked = [ids.where(F.col("label") == c).orderBy("h", "doc_id").limit(p.sample_per_class) for c in (0, 1)]
    few = F.broadcast(picked[0].unionAll(picked[1]))  # at most 2 * sample_per_class rows of three numbers
    texts = short.join(few, "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))
    got = sorted(((r["h"], r["doc_id"], r["label"], r["text"]) for r in texts.collect()))  # bounded by the two parameters
    return [(label, text.encode("utf-8", "replace")) for _, _, label, text in got], {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}


def token_labels(texts: list[list[int]], labels: np.ndarray, vocab: list[list[int]], p: ToxicParams) -> np.ndarray:
    """Of each distinct token, whether its word or a beginning of it marks toxic documents."""
    size, total = 1 << BITS, [max(1, int((labels == c).sum())) for c in (0, 1)]
    held = [np.zeros(size), np.zeros(size)]
    for ids, c in zip(texts, labels):
        seen = {f for k in set(ids) for f in vocab[k]}
        held[c][list(seen)] += 1
    odds = np.log((held[1] + 0.5) / (total[1] + 1)) - np.log((held[0] + 0.5) / (total[0] + 1))
    marks = (odds >= p.least_odds) & (held[1] >= p.least_docs)
    return np.array([bool(marks[f].any()) for f in vocab])


def train(texts: list[list[int]], y: np.ndarray, vocab: list[tuple[list[int], int, int]], p: ToxicParams) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights of the field by Adam on the exact gradient of the log likelihood of the token labels ``y``."""
    size = 1 << BITS
    ids = np.concatenate([np.array(t, np.int64) for t in texts])
    first = np.zeros(len(ids), bool)
    first[np.cumsum([0] + [len(t) for t in texts[:-1]])] = True
    row = np.repeat(np.arange(len(vocab)), [len(v[0]) for v in vocab])
    own = np.concatenate([np.array(v[0], np.int64) for v in vocab])
    before, after = np.array([v[1] for v in vocab]), np.array([v[2] for v in vocab])
    inner = np.flatnonzero(~first)
    w = np.zeros(size + 7)  # features; bias; chain 00 01 10 11; start 0 1
    w[size] = -2.0
    mean, square = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, p.rounds + 1):
        chain, start = w[size + 1 : size + 5].reshape(2, 2), w[size + 5 :]
        lent = np.bincount(row, weights=w[own], minlength=len(vocab)) + w[size]
        e = emissions(lent, w[before], w[after], ids, first)
        forward, backward, m = messages(e, first, chain, start)
        node = forward * backward
        node /= node.sum(1, keepdims=True)
        grad = np.zeros_like(w)
        err = node[:, 1] - y
        grad[size] = err.sum()
        grad[:size] = np.bincount(own, weights=np.bincount(ids, weights=err, minlength=len(vocab))[row], minlength=size)
        grad[:size] += np.bincount(before, weights=np.bincount(ids[inner - 1], weights=err[inner], minlength=len(vocab)), minlength=size)
        grad[:size] += np.bincount(after, weights=np.bincount(ids[inner], weights=err[inner - 1], minlength=len(vocab)), minlength=size)
        pair = m[inner] * forward[inner - 1][:, [0, 0, 1, 1]] * backward[inner][:, [0, 1, 0, 1]]
        pair /= pair.sum(1, keepdims=True)
        seen = np.bincount(2 * y[inner - 1] + y[inner], minlength=4)
        grad[size + 1 : size + 5] = pair.sum(0) - seen
        grad[size + 5 :] = node[first].sum(0) - np.bincount(y[first], minlength=2)
        grad = grad / len(texts) + p.l2 * w
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad * grad
        w = w - p.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return w[:size].astype(np.float32), float(w[size]), w[size + 1 : size + 5].reshape(2, 2).copy(), w[size + 5 :].copy()


def gather(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of document labels on ``doc_features``: Newton steps, halved until the loss falls."""
    ridge = np.array([1e-2, 1e-2, 1e-2, 1e-6])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (ridge * w * w).sum() / 2)

    w = np.zeros(x.shape[1])
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        g = x.T @ (weight * (q - y)) + ridge * w
        step, scale, now = np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + np.diag(ridge + 1e-9), g), 1.0, loss(w)
        while scale > 1e-6 and loss(w - scale * step) > now:
            scale /= 2
        w = w - scale * step
        if np.abs(scale * step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, p: ToxicParams = ToxicParams()) -> ToxicModel:
    """The field on two thirds of the bounded sample, the aggregation on the last third, weighted to all rows' class shares."""
    rows, times = sample(docs, labels, p)
    none = ToxicModel(None, 0.0, np.zeros((2, 2)), np.zeros(2), np.zeros(4), p.span)
    index: dict[bytes, int] = {}
    texts = [[index.setdefault(t, len(index)) for t in text.split()] for _, text in rows]
    vocab = [token_features(t) for t in index]
    y = np.array([label for label, _ in rows], np.int64)
    rest = np.arange(len(rows)) % p.calibrate_mod != 0
    learn = [k for k in np.flatnonzero(rest) if texts[k]]
    if len(set(y[rest].tolist())) < 2 or len(set(y[~rest].tolist())) < 2 or not learn:
        return none
    marks = token_labels([texts[k] for k in learn], y[learn], [v[0] for v in vocab], p)
    target = np.concatenate([marks[texts[k]] & (y[k] == 1) for k in learn]).astype(np.int64)
    w, bias, chain, start = train([texts[k] for k in learn], target, vocab, p)
    model = ToxicModel(w, bias, chain, start, np.zeros(4), p.span)
    held = np.flatnonzero(~rest)
    x = features_of([rows[k][1] for k in held], model, _Known(model))[0]
    weight = np.array([times[c] / max(1, int((y[held] == c).sum())) for c in y[held]])
    return ToxicModel(w, bias, chain, start, gather(x, y[held].astype(float), weight / weight.mean()), p.span)


def features_of(texts: list[bytes], model: ToxicModel, known: _Known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document features, marginals of all tokens, ends of the texts among them)."""
    tokens = [t.split() for t in texts]
    ends = np.cumsum([len(t) for t in tokens]) if tokens else np.zeros(0, np.int64)
    ids = np.fromiter((known[w] for t in tokens for w in t), np.int64, int(ends[-1]) if tokens else 0)
    first = np.zeros(len(ids) + 1, bool)
    first[0] = True
    first[ends] = True
    first = first[: len(ids)]
    own, before, after = (np.array(x) for x in (known.own, known.before, known.after))
    p = marginals(emissions(own, before, after, ids, first), first, model.chain, model.start) if len(ids) else np.zeros(0)
    return doc_features(p, ends), p, ends


def spans(text: bytes, p: np.ndarray, least: float) -> list[dict]:
    """Runs of tokens whose marginal reaches ``least``: code point offsets (end excluded) and the run's largest marginal."""
    out: list[dict] = []
    hot = p >= least
    if not hot.any():
        return out
    previous, at, chars = False, 0, 0
    for k, m in enumerate(_TOKEN.finditer(text)):
        if hot[k]:
            chars += len(text[at : m.start()].decode("utf-8", "replace"))
            width = len(m.group().decode("utf-8", "replace"))
            if previous:
                out[-1]["end"], out[-1]["p"] = chars + width, max(out[-1]["p"], float(p[k]))
            else:
                out.append({"start": chars, "end": chars + width, "p": float(p[k])})
            at, chars = m.end(), chars + width
        previous = bool(hot[k])
    return out


RESULT = T.StructType([T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
                       T.StructField("n_words", T.LongType()), T.StructField("n_spans", T.LongType()),
                       T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())])))])
_ARROW = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())]))]


def judge(docs: DataFrame, model: ToxicModel, fold_mod: int = ToxicParams.fold_mod, carry: list[str] | None = None) -> DataFrame:
    """The ``carry`` columns (all by default) of every row and the columns of ``RESULT``: whether the row was kept from
    learning, its score, ``predicted``, its words, its toxic spans and their number.

    Null and empty texts have no tokens, so they get the score of a text without any sign; very long texts are read
    whole; repeated rows are judged row by row; a null doc_id counts as the empty one; a carried column with the
    name of a result column gets leading underscores until its name is free; an empty table gives an empty one.
    """
    carry = docs.columns if carry is None else carry
    names = free_names(carry, [f.name for f in RESULT])
    fold = (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % fold_mod == 0)
    inner = [f"c{k}" for k in range(len(carry))]
    source = docs.select(*[F.col(f"`{n}`").alias(m) for n, m in zip(carry, inner)], fold.alias("fold"), F.col("text").cast("string").alias("body"))
    cell = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS float32 and a few numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cell.value
        known = _Known(m)
        for part in slices(batches, "body"):
            texts = utf8(part, "body")
            if m.weights is None:
                score, found, words = np.zeros(len(texts)), [[] for _ in texts], [len(t.split()) for t in texts]
            else:
                if len(known) > KNOWN_TOKENS:
                    known = _Known(m)
                x, p, ends = features_of(texts, m, known)
                score = 1 / (1 + np.exp(-np.clip(x @ m.gather, -35, 35)))
                words = np.diff(ends, prepend=0)
                found = [spans(t, p[e - n : e], m.span) for t, e, n in zip(texts, ends, words)]
            out = [score, (score >= 0.5).astype(np.int32), words, [len(f) for f in found], found]
            yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(inner) + 1)] + [pa.array(c, k) for c, k in zip(out, _ARROW)],
                                             inner + [f.name for f in RESULT])

    fields = [T.StructField(n, f.dataType) for n, f in zip(inner, source.schema.fields)]
    done = source.mapInArrow(run, T.StructType(fields + RESULT.fields))
    return done.select(*[F.col(i).alias(n) for i, n in zip(inner, names)], *[f.name for f in RESULT])


def toxicity(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams(), carry: list[str] | None = None) -> DataFrame:
    """Fits on ``labels`` (doc_id, toxic) and judges every row of ``docs`` (doc_id, text); see ``judge`` for odd input."""
    return judge(docs, fit(docs, labels, params), params.fold_mod, carry)
