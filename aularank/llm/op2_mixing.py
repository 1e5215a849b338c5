"""Language-model scoring by online logistic context mixing over the bits of each token.

Tokens are lower-cased words and one end mark a text.  A token is coded byte by byte, bit by bit: predictors for
hashed contexts (the last two to four bytes, and the whole word so far) give stretched probabilities; a mixer whose
weights are gated by how well the contexts are known adds them; a table of adaptive probabilities refines the sum.
The predictors' counts come from all training texts, a token once from each text that holds it; mixer and refinement learn
online from the same tokens, each leaving itself out of the counts it is predicted from.  Within a text, tokens already seen there are mixed in,
and a Bayesian mixture over several rates adapts to the text.

A token's bits depend on the token alone, so each distinct token is scored once and joined back to the texts; a
text travels as numbers local to its chunk, a chunk's words once.  Counts are kept for every context, in buckets whose
number follows the distinct words: each batch of words asks the buckets for its contexts and gets their counts back.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aularank.llm.common import cut, from_ipc, slices, to_ipc, utf8

END = b"\n"
#: Slots of each predictor in a table of one's own (``bit_counts``): contexts of 2, 3, 4 bytes and the word so far.
SLOT_BITS = (20, 20, 21, 21)
OFFSETS = np.concatenate([[0], np.cumsum([1 << b for b in SLOT_BITS])]).astype(np.int64)
SLOTS = int(OFFSETS[-1])
INPUTS = len(SLOT_BITS) + 1  # and a constant
GATES = 11 * 4
BINS = 33
FADE = 0.998
#: Rates at which a text's own earlier tokens are mixed in; the text's tokens decide between them.
RATES = (0.0, 0.05, 0.2, 0.6)
#: Weights of a token's share of the training tokens against the probability from its bits.
WEIGHTS = (0.0, 0.4, 0.8)

_P, _PI = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64)


@dataclass(frozen=True)
class LmParams:
    """``chunk_bytes``: text whose words are numbered together.  ``batch_bytes``: distinct words that ask for counts
    together.  ``bucket_bytes``: bytes of distinct words for each bucket of counts.  ``held_mod``, ``held_rest``: texts whose crc32(doc_id) leaves this rest are not learned from."""

    chunk_bytes: int = 32 << 20
    batch_bytes: int = 1 << 20
    bucket_bytes: int = 1 << 19
    held_mod: int = 7
    held_rest: int = 2


def _coded(words: list[bytes]) -> list[bytes]:
    """Words with the space that ends them; the end mark stands for itself."""
    return [w if w == END else w + b" " for w in words]


def contexts(words: list[bytes], frequent: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All bytes of the coded words, the context hash of each predictor at each byte, and each byte's word.

    ``frequent``: sorted hashes of the beginnings of frequent words; the word so far is a context only if it is one
    of them (else 0), so rare words cannot crowd its table.
    """
    coded = _coded(words)
    b = np.frombuffer(b"".join(coded), np.uint8).astype(np.uint64)
    n = len(b)
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    start = np.repeat(np.cumsum(size) - size, size)
    at = np.arange(n) - start
    one = np.uint64(1)
    power, back = np.full(n, _P, np.uint64), np.full(n, _PI, np.uint64)
    power[:1] = back[:1] = one
    power, back = np.cumprod(power, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)
    total = np.concatenate([[np.uint64(0)], np.cumsum((b + one) * power, dtype=np.uint64)])
    whole = (total[np.arange(n)] - total[start]) * back[start] + np.uint64(1315423911)
    if frequent is not None:
        at_most = np.minimum(np.searchsorted(frequent, whole), max(len(frequent) - 1, 0))
        whole = np.where(frequent[at_most] == whole, whole, np.uint64(0)) if len(frequent) else np.zeros(n, np.uint64)
    last = []
    before = np.zeros(n, np.uint64)
    for k in range(1, 5):
        shifted = np.zeros(n, np.uint64)
        shifted[k:] = b[:-k] + one if n > k else 0
        shifted[at < k] = 0
        before = before | shifted << np.uint64(9 * (k - 1))
        if k > 1:
            last.append((before + np.uint64(k)) * np.uint64(0xD6E8FEB86659FD93))
    return b, [*last, whole], np.repeat(np.arange(len(words)), size)


def slots(ctx: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """The table slot of each predictor for a partial byte."""
    out = []
    for k, (c, bits) in enumerate(zip(ctx, SLOT_BITS)):
        h = c + node * np.uint64(0xA0761D6478BD642F)  # the contexts are mixed already
        h ^= h >> np.uint64(29)
        out.append((h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64) + OFFSETS[k])
    out[-1][ctx[-1] == 0] = SLOTS  # no such context: a slot that stays empty
    return out


def bit_counts(words: list[bytes], times: np.ndarray, zeros: np.ndarray, ones: np.ndarray, frequent: np.ndarray) -> None:
    """Adds every bit of the words, each as often as its word occurs, to the counts of all predictors."""
    b, ctx, word = contexts(words, frequent)
    w = times[word].astype(np.float64)
    for k in range(8):
        node = np.uint64(1 << k) | b >> np.uint64(8 - k)
        bit = (b >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
        for own in slots(ctx, node):
            np.add.at(ones, own[bit], w[bit])
            np.add.at(zeros, own[~bit], w[~bit])
    zeros[SLOTS] = ones[SLOTS] = 0


def _stretch(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return np.log((n1 + 0.35) / (n0 + 0.35))


def _gate(total_word: np.ndarray, total_four: np.ndarray) -> np.ndarray:
    """The mixer's weight set: by how often the word so far and the last four bytes were seen."""
    a = np.minimum(np.ceil(np.log2(np.maximum(total_word, 0) + 1) / 1.5), 10).astype(np.int64)
    c = np.minimum(np.ceil(np.log2(np.maximum(total_four, 0) + 1) / 2.5), 3).astype(np.int64)
    return a * 4 + c


def _slot_counts(tables: tuple[np.ndarray, np.ndarray, np.ndarray], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
    zeros, ones, frequent = tables
    b, ctx, word = contexts(words, frequent)
    return b, word, lambda k: [(zeros[own], ones[own]) for own in slots(ctx, np.uint64(1 << k) | b >> np.uint64(8 - k))]


def _slot_inputs(tables: tuple[np.ndarray, np.ndarray, np.ndarray], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
    stretch, known, frequent = tables
    b, ctx, word = contexts(words, frequent)

    def at(k: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        own = slots(ctx, np.uint64(1 << k) | b >> np.uint64(8 - k))
        return [stretch[x] for x in own], [known[x].astype(np.float64) for x in own]

    return b, word, at


def codes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each predictor and byte, 56 hash bits of the context and then the byte; all bytes; each byte's word."""
    b, ctx, word = contexts(words)
    out = np.empty((len(ctx), len(b)), np.uint64)
    for k, c in enumerate(ctx):
        h = (c + np.uint64(k + 1) * np.uint64(0x632BE59BD9B4E019 >> 3)) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        out[k] = h & ~np.uint64(255) | b
    return out, b, word


def path_counts(every: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For sorted distinct codes with counts, how often their context went on with a byte of the same first 0 to 8 bits."""
    path = np.empty((9, len(every)), np.int64)
    for j in range(9):
        head = every >> np.uint64(8 - j)
        start = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]]))
        path[j] = np.repeat(np.add.reduceat(n, start), np.diff(np.append(start, len(head))))
    return path


class Paths:
    """Counts of all contexts that a batch of words meets, one path of nine numbers for each distinct code."""

    def __init__(self, words: list[bytes], path: np.ndarray | None = None, times: np.ndarray | None = None):
        own, self.b, self.word = codes(words)
        self.every, place = np.unique(own, return_inverse=True)
        self.place = place.reshape(own.shape)
        if times is not None:
            self.n = np.bincount(place.ravel(), np.tile(times[self.word], len(own)), len(self.every)).astype(np.int64)
        self.path = path

    def counts(self, words: list[bytes], at: int) -> tuple[np.ndarray, np.ndarray, Callable]:
        """Bytes and words from byte ``at`` on, and each predictor's counts of zeros and ones at a bit."""
        size = sum(len(w) + (w != END) for w in words)
        b, word = self.b[at: at + size], self.word[at: at + size]

        def of(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
            bit, out = (b >> np.uint64(7 - k) & np.uint64(1)).astype(bool), []
            for place in self.place[:, at: at + size]:
                same = self.path[k + 1][place].astype(np.float64)
                other = self.path[k][place] - same
                out.append((np.where(bit, other, same), np.where(bit, same, other)))
            return out

        return b, word - word[0], of

    def inputs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, Callable]:
        def of(k: int) -> tuple[np.ndarray, np.ndarray]:
            same, total = self.path[k + 1], self.path[k]
            bit = (self.every >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            stretch = np.where(bit, 1, -1) * _stretch(total - same, same)
            return stretch[self.place], total[self.place].astype(np.float64)

        return self.b, self.word, of


@dataclass
class Mixer:
    """Gated weights and the refinement's counts, learned online."""

    weights: np.ndarray
    seen: np.ndarray
    curve: np.ndarray
    zeros: np.ndarray
    ones: np.ndarray

    @staticmethod
    def fresh() -> Mixer:
        w = np.full((GATES, INPUTS), 0.25)
        w[:, -1] = 0.0
        return Mixer(w, np.zeros(GATES), np.tile(np.eye(INPUTS) * 5.0, (GATES, 1, 1)), np.zeros((GATES, BINS)), np.zeros((GATES, BINS)))

    def learn(self, tables, words: list[bytes], times: np.ndarray, batch: int = 4000) -> None:
        """One online pass over the words: after each bit position of a small batch, a Newton step in every gate by
        the curvature seen so far (old curvature fades slowly).  ``tables``: slots (zeros, ones, frequent) or ``Paths``."""
        at = 0
        for start in range(0, len(words), batch):
            own = words[start: start + batch]
            b, word, counts = tables.counts(own, at) if isinstance(tables, Paths) else _slot_counts(tables, own)
            at += len(b)
            self._learn(b, times[start: start + batch][word].astype(np.float64), counts)

    def _learn(self, b: np.ndarray, w: np.ndarray, counts: Callable) -> None:
        for k in range(8):
            bit = (b >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
            x, totals = np.ones((INPUTS, len(b))), []
            for i, (n0, n1) in enumerate(counts(k)):
                n1 = np.maximum(n1 - bit, 0)  # the token itself left out
                n0 = np.maximum(n0 - (1 - bit), 0)
                x[i] = _stretch(n0, n1)
                totals.append(n0 + n1)
            gate = _gate(totals[3], totals[2])
            z = np.clip((self.weights[gate].T * x).sum(0), -16, 16)
            p = 1 / (1 + np.exp(-z))
            level = np.clip(np.rint(z * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)
            at = gate * BINS + level
            self.ones += np.bincount(at, w * bit, GATES * BINS).reshape(GATES, BINS)
            self.zeros += np.bincount(at, w * (1 - bit), GATES * BINS).reshape(GATES, BINS)
            self.seen += np.bincount(gate, w, GATES)
            order = np.argsort(gate, kind="stable")
            ends = np.searchsorted(gate[order], np.arange(GATES), side="right")
            start = 0
            for g, end in enumerate(ends):
                if end > start and w[order[start:end]].any():
                    own = order[start:end]
                    xs, bend = x[:, own], w[own] * np.maximum(p[own] * (1 - p[own]), 1e-3)
                    self.curve[g] = self.curve[g] * FADE + (xs * bend) @ xs.T
                    step = np.linalg.solve(self.curve[g] + np.eye(INPUTS), xs @ (w[own] * (bit[own] - p[own])))
                    self.weights[g] += np.clip(step, -0.25, 0.25)
                start = end

    def score(self, tables, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word, its ending included.  ``tables``: slots (stretch, known, frequent) or ``Paths``."""
        b, word, inputs = tables.inputs(words) if isinstance(tables, Paths) else _slot_inputs(tables, words)
        total = np.zeros(len(b))
        curve = (self.ones + 0.5) / (self.ones + self.zeros + 1.0)
        trust = (self.ones + self.zeros) / (self.ones + self.zeros + 50.0) * 0.5
        for k in range(8):
            bit = (b >> np.uint64(7 - k) & np.uint64(1)).astype(np.float64)
            x, known = inputs(k)
            gate = _gate(known[3], known[2])
            weights = self.weights[gate]
            z = weights[:, -1].copy()
            for i in range(INPUTS - 1):
                z += weights[:, i] * x[i]
            z = np.clip(z, -16, 16)
            p = 1 / (1 + np.exp(-z))
            at = gate * BINS + np.clip(np.rint(z * 2) + BINS // 2, 0, BINS - 1).astype(np.int64)
            t = trust.ravel()[at]
            p = np.clip(p * (1 - t) + curve.ravel()[at] * t, 1e-7, 1 - 1e-7)
            total += np.log10(np.where(bit > 0, p, 1 - p))
        return np.bincount(word, total, len(words))


TEXTS, WORDS = 0, 1


def chunked(docs: DataFrame, p: LmParams, doc_id: str, text: str) -> DataFrame:
    """(chunk, kind, body) from one reading of the texts, written to the shared folder: compressed batches of TEXTS
    (doc_id, held, tokens as the chunk's word numbers) and of WORDS (number, word, times in training texts, training texts with it)."""
    held = F.pmod(F.crc32(F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), F.lit("")).cast("binary")), F.lit(p.held_mod)) == p.held_rest
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), held.alias("held"), F.col(f"`{text}`").cast("string").alias("text"))

    def row(chunk: int, kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([to_ipc(batch)], pa.binary())], ["chunk", "kind", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 24
        number: dict[bytes, int] = {END: 0}
        times, size, filled = np.zeros((2, 1 << 16), np.int64), 0, False

        def words() -> Iterator[pa.RecordBatch]:
            every = list(number)
            for at in range(0, len(every), 50_000):
                own = every[at: at + 50_000]
                yield row(chunk, WORDS, pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(at, at + len(own), dtype=np.int32)), pa.array(own, pa.binary()), *map(pa.array, times[:, at: at + len(own)])], ["number", "word", "times", "texts"]))

        for part in slices(batches, "text"):
            tokens = []
            helds = part.column(1)
            for data, is_held in zip(utf8(part, "text"), helds.to_pylist()):
                split = data.lower().split()
                split.append(END)
                own = np.fromiter([number.setdefault(w, len(number)) for w in split], np.int32, len(split))
                if len(number) > times.shape[1]:
                    times = np.concatenate([times, np.zeros((2, max(times.shape[1], len(number) - times.shape[1])), np.int64)], axis=1)
                if not is_held:
                    np.add.at(times[0], own, 1)
                    times[1, own] += 1
                tokens.append(own)
                size += len(data)
            filled = True
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]), pa.int64())
            lists = pa.LargeListArray.from_arrays(offsets, pa.array(np.concatenate(tokens)))
            yield row(chunk, TEXTS, pa.RecordBatch.from_arrays([part.column(0), helds, lists], ["doc_id", "held", "tokens"]))
            if size >= p.chunk_bytes:
                yield from words()
                chunk, size, filled = chunk + 1, 0, False
                number, times = {END: 0}, np.zeros((2, 1 << 16), np.int64)
        if filled:
            yield from words()

    return cut(source.mapInArrow(run, "chunk long, kind int, body binary"))


def chunk_words(rows: DataFrame) -> DataFrame:
    """(of, number, word, times, texts): the words of every chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                for part in from_ipc(body.as_py()).to_batches():
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(part.num_rows, chunk)), *part.columns], ["of", "number", "word", "times", "texts"])

    return rows.where(F.col("kind") == WORDS).select("chunk", "body").mapInArrow(run, "of long, number int, word binary, times long, texts long")


def beginnings(words: list[bytes]) -> np.ndarray:
    """Sorted hashes of all beginnings of the words."""
    return np.unique(contexts(words)[1][-1]) if words else np.zeros(0, np.uint64)


def batches_of(vocabulary: DataFrame, p: LmParams) -> DataFrame:
    """(batch, n, v, size, body): distinct words in compressed batches, written to the shared folder; training tokens,
    training words and bytes of each."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, held, size = TaskContext.get().partitionId() << 24, [], 0

        def row() -> pa.RecordBatch:
            own = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            c = own.column(1).to_numpy()
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (batch, int(c.sum()), int((c > 0).sum()), size)] + [pa.array([to_ipc(own)], pa.binary())],
                                              ["batch", "n", "v", "size", "body"])

        for part in batches:
            for own in slices(iter([part]), "word", p.batch_bytes):
                held.append(own)
                size += int(pa.compute.sum(pa.compute.binary_length(own.column(0))).as_py()) + own.num_rows
                if size >= p.batch_bytes:
                    yield row()
                    batch, held, size = batch + 1, [], 0
        if held:
            yield row()

    return cut(vocabulary.select("word", "c", "texts").mapInArrow(pack, "batch long, n long, v long, size long, body binary"))


def opened(body: bytes) -> tuple[pa.Table, list[bytes], np.ndarray]:
    """A batch's rows, words, and how many training texts hold each."""
    t = from_ipc(body)
    return t, t["word"].to_pylist(), t["texts"].to_numpy()


def count_paths(packed: DataFrame, size: int, p: LmParams) -> DataFrame:
    """(batch, bucket, body): the counts, over all training tokens, of every context that a batch's words meet, in the
    order of the batch's codes.  A code belongs to one bucket, which adds up what all batches count of it."""
    buckets = max(6, math.ceil(size / p.bucket_bytes))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for batch, body in zip(rows.column(0).to_pylist(), rows.column(1)):
                _, words, times = opened(body.as_py())
                own = Paths(words, times=times)
                at = ((own.every >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                for lo, hi in zip(start, np.append(start[1:], len(at))):
                    body = to_ipc(pa.RecordBatch.from_arrays([pa.array(own.every[lo:hi]), pa.array(own.n[lo:hi])], ["code", "n"]))
                    yield pa.RecordBatch.from_arrays([pa.array([at[lo]], pa.int64()), pa.array([batch], pa.int64()), pa.array([body], pa.binary())], ["bucket", "batch", "body"])

    def answer(t: pa.Table) -> pa.Table:
        asked = [from_ipc(x.as_py()) for x in t["body"]]
        every, place = np.unique(np.concatenate([x["code"].to_numpy() for x in asked]), return_inverse=True)
        n = np.bincount(place, np.concatenate([x["n"].to_numpy() for x in asked]), len(every)).astype(np.int64)
        path, out, at = path_counts(every, n), [], 0
        for x in asked:
            own = path[:, place[at: at + x.num_rows]]
            at += x.num_rows
            steps = [own[0], *(own[:-1] - own[1:])]  # mostly zeros
            out.append(to_ipc(pa.RecordBatch.from_arrays([pa.array(s) for s in steps], list("abcdefghi"))))
        return pa.table([t["batch"], t["bucket"], pa.array(out, pa.binary())], ["batch", "bucket", "body"])

    asked = packed.select("batch", "body").mapInArrow(ask, "bucket long, batch long, body binary")
    return cut(asked.groupBy("bucket").applyInArrow(answer, "batch long, bucket long, body binary"))


def answered(words: list[bytes], answers: pa.Table) -> Paths:
    """A batch's words with the counts of their contexts."""
    own, at = Paths(words), 0
    path = np.empty((9, len(own.every)), np.int32)  # counts of whole texts: 32 bits nearly always do
    for i in np.argsort(answers["bucket"].to_numpy()):
        part = from_ipc(answers["body"][int(i)].as_py())
        if path.dtype == np.int32 and part.num_rows and pa.compute.max(part["a"]).as_py() >= 2**31:
            path = path.astype(np.int64)
        for j, name in enumerate("abcdefghi"):
            path[j, at: at + part.num_rows] = part[name].to_numpy()
        at += part.num_rows
    for j in range(1, 9):
        path[j] = path[j - 1] - path[j]
    own.path = path
    return own


def learn_mixer(packed: DataFrame, paths: DataFrame) -> Mixer:
    """Each batch learns online from its training words; weights are averaged by what each gate has seen."""
    def learn(t: pa.Table, answers: pa.Table) -> pa.Table:
        m = Mixer.fresh()
        for body in t["body"]:
            _, words, times = opened(body.as_py())
            m.learn(answered(words, answers), words, times)  # a word of held-out texts alone weighs nothing
        body = np.concatenate([(m.weights * m.seen[:, None]).ravel(), m.seen, m.zeros.ravel(), m.ones.ravel()])
        return pa.table([pa.array([body.tobytes()], pa.binary())], ["body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GATES * INPUTS + GATES + 2 * GATES * BINS)
        for batch in batches:
            for body in batch.column(0):
                total += np.frombuffer(body.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["body"])

    learnt = packed.select("batch", "body").groupBy("batch").cogroup(paths.groupBy("batch")).applyInArrow(learn, "body binary")
    a, b = GATES * INPUTS, GATES * BINS
    body = np.zeros(a + GATES + 2 * b)
    for r in learnt.repartition(12).mapInArrow(add, "body binary").collect():  # twelve sums, whatever the corpus
        body += np.frombuffer(r["body"])
    m = Mixer.fresh()
    weights, seen = body[:a].reshape(GATES, INPUTS), body[a: a + GATES]
    m.weights = np.where(seen[:, None] > 0, weights / np.maximum(seen[:, None], 1e-9), m.weights)
    m.seen, m.zeros, m.ones = seen, body[a + GATES: a + GATES + b].reshape(GATES, BINS), body[a + GATES + b:].reshape(GATES, BINS)
    return m


def text_score(tokens: np.ndarray, logp: np.ndarray, share: np.ndarray) -> float:
    """log10 probability of a text.

    Each token's probability from its bits is mixed with its share of all training tokens and with its share of the
    text's own earlier tokens, at several weights and rates; a Bayesian mixture over these adapts to the text: the
    tokens so far weigh the next one's mixture, and the product of all is the text's probability.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    same = np.concatenate([[False], tokens[order][1:] == tokens[order][:-1]])
    run = np.arange(n)
    run = run - np.maximum.accumulate(np.where(same, 0, run))
    before = np.empty(n)
    before[order] = run
    at = np.arange(n)
    own, grown = before / np.maximum(at, 1), at / (at + 20.0)
    with np.errstate(divide="ignore"):  # a log of zero is a term that adds nothing
        own, known, grown_log = np.log(own), np.log(share[tokens]), np.log(grown)
    bits = logp[tokens] * math.log(10.0)
    total = []
    for weight in WEIGHTS:  # in logarithms throughout: an unbroken token of many bytes has no lower bound
        static = np.logaddexp(bits + math.log1p(-weight), known + math.log(weight)) if weight else bits
        for rate in RATES:
            mixed = np.logaddexp(static + np.log1p(-rate * grown), own + grown_log + math.log(rate)) if rate else static
            total.append(mixed.sum() / math.log(10.0))
    top = max(total)
    return float(top + np.log10(np.mean([10.0 ** (t - top) for t in total])))


def score(docs: DataFrame, params: LmParams = LmParams(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    A null or empty text is its end mark alone.  A null doc_id counts as an empty one in the hold-out rule.
    Repeated rows are scored, and learned from, one by one; long texts whole; other columns are not read.  Without
    training texts the base score is 0 for each token and the model gives each bit a half.  An empty table gives
    an empty one.
    """
    spark = docs.sparkSession
    rows = chunked(docs, params, doc_id, text)
    words = chunk_words(rows)
    packed = batches_of(words.groupBy("word").agg(F.sum("times").alias("c"), F.sum("texts").alias("texts")), params)
    sums = packed.agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("size").alias("size")).first()
    n, v = int(sums["n"] or 0), int(sums["v"] or 0)
    paths = count_paths(packed, int(sums["size"] or 0), params)
    mixer = learn_mixer(packed, paths)
    cell = spark.sparkContext.broadcast((mixer.weights, mixer.seen, mixer.curve, mixer.zeros, mixer.ones))  # as many as gates

    def run(t: pa.Table, answers: pa.Table) -> pa.Table:
        m, out = Mixer(*cell.value), []
        for body in t["body"]:
            own, every, _ = opened(body.as_py())
            out.append(own.select(["word", "c"]).append_column("logp", pa.array(m.score(answered(every, answers), every).astype(np.float32))))
        return pa.concat_tables(out)

    scored = packed.select("batch", "body").groupBy("batch").cogroup(paths.groupBy("batch")).applyInArrow(run, "word binary, c long, logp float")
    placed = words.select("of", "number", "word").join(scored, "word").select("of", "number", "c", "logp")
    texts = rows.where(F.col("kind") == TEXTS).select("chunk", "body")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def finish(t: pa.Table, w: pa.Table) -> pa.Table:
        size = int(pa.compute.max(w["number"]).as_py()) + 1 if w.num_rows else 0
        at = w["number"].to_numpy()
        c, logp = np.zeros(size, np.int64), np.zeros(size)
        c[at], logp[at] = w["c"].to_numpy(), w["logp"].to_numpy()
        base, share = np.log10((c + 1) / (n + (v + 1))), c / max(n, 1)
        ids, helds, out = [], [], [[], [], [], []]
        for blob in t["body"]:
            for part in from_ipc(blob.as_py()).to_batches():
                ids.append(part.column(0))
                helds.append(part.column(1))
                flat, ends = part.column(2).values.to_numpy(), part.column(2).offsets.to_numpy()
                for start, end in zip(ends[:-1], ends[1:]):
                    tokens = flat[start:end]
                    for column, x in zip(out, (len(tokens), int((c[tokens] > 0).sum()), float(base[tokens].sum()), text_score(tokens, logp, share))):
                        column.append(x)
        return pa.table([pa.chunked_array(ids, pa.int64()), pa.chunked_array(helds, pa.bool_()), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                         pa.array(np.full(len(out[0]), n)), pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())], names)

    return texts.groupBy("chunk").cogroup(placed.groupBy("of")).applyInArrow(finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
