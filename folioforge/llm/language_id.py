"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of labelled documents. It labels
every position of every text, in windows of WINDOW bytes, and a document's probabilities are the mean over its positions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a window, windows of a text in the training sample, labelled texts in it at most (in round numbers), and languages learned.
WINDOW, SAMPLE_WINDOWS, SAMPLE_DOCUMENTS, LANGUAGES = 64, 3, 3000, 200
HIDDEN, EPOCHS, BATCH, RATE, SEED, RARE = 12, 8, 128, 0.01, 7, 20
#: Windows labelled together.
TOGETHER = 4096
LETTER = re.compile(r"[^\W\d_]")
GATES = 3


class Network:
    """Two gated recurrent layers, one from either end, and a linear layer on both at each position.

    For each direction d: W[d] gives a byte's inputs to the gates (256 x 3H), U[d] the state's (H x 3H). Gates in order: update z,
    reset r, candidate c. h' = h + z * (c - h), c = tanh(x_c + r * (h U_c)).
    """

    def __init__(self, labels: list[str], hidden: int = HIDDEN, seed: int = SEED):
        r = np.random.default_rng(seed)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.labels, self.hidden = labels, hidden
        self.W = (r.standard_normal((2, 257, GATES * hidden)) * 0.3).astype(np.float32)  # 256 is the padding
        self.U = draw(2, hidden, GATES * hidden)
        self.V, self.b = draw(2 * hidden, len(labels)), np.zeros(len(labels), np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """x: (B, T) bytes. States (T, 2, B, H), direction 1 in its own order of time; with keep, also what backward needs."""
        n, steps, size = len(x), x.shape[1], self.hidden
        h = np.zeros((2, n, size), np.float32)
        states, tape = np.empty((steps, 2, n, size), np.float32), []
        one = np.float32(1)
        for t in range(steps):
            a = np.stack([self.W[0].take(x[:, t], axis=0), self.W[1].take(x[:, steps - 1 - t], axis=0)])
            u = h @ self.U
            zr = a[..., : 2 * size] + u[..., : 2 * size]
            zr *= np.float32(0.5)
            np.tanh(zr, out=zr)
            zr += one
            zr *= np.float32(0.5)
            z, r = zr[..., :size], zr[..., size:]
            c = a[..., 2 * size :] + r * u[..., 2 * size :]
            np.tanh(c, out=c)
            if keep:
                tape.append((h, z, r, c, u[..., 2 * size :]))
            h = h + z * (c - h)
            states[t] = h
        return (states, tape) if keep else states

    def logits(self, states: np.ndarray) -> np.ndarray:
        """(T, B, L)."""
        size = self.hidden
        return states[:, 0] @ self.V[:size] + states[::-1, 1] @ self.V[size:] + self.b

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients of (W, U, V, b) for labels y (B) at each position; weight: (B, T), 0 at the padding."""
        states, tape = self.forward(x, True)
        steps, size = x.shape[1], self.hidden
        p = self.logits(states)
        p -= p.max(axis=-1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=-1, keepdims=True)
        w = (weight / weight.sum()).T
        loss = float(-(np.log(np.take_along_axis(p, np.broadcast_to(y, p.shape[:2])[..., None], -1)[..., 0] + 1e-9) * w).sum())
        p[:, np.arange(len(y)), y] -= 1
        p *= w[..., None]
        V = np.concatenate([np.tensordot(states[:, 0], p, ((0, 1), (0, 1))), np.tensordot(states[::-1, 1], p, ((0, 1), (0, 1)))])
        out = np.stack([p @ self.V[:size].T, (p @ self.V[size:].T)[::-1]], axis=1)
        W, U, carry = np.zeros_like(self.W), np.zeros_like(self.U), np.zeros_like(tape[0][0])
        for t in range(steps - 1, -1, -1):
            h, z, r, c, u = tape[t]
            d = out[t] + carry
            dc = d * z * (1 - c * c)
            dz, dr = d * (c - h) * z * (1 - z), dc * u * r * (1 - r)
            a = np.concatenate([dz, dr, dc], axis=-1)  # to the byte's inputs
            s = np.concatenate([dz, dr, dc * r], axis=-1)  # to the state's
            carry = d * (1 - z) + s @ self.U.transpose(0, 2, 1)
            U += h.transpose(0, 2, 1) @ s
            np.add.at(W[0], x[:, t], a[0])
            np.add.at(W[1], x[:, steps - 1 - t], a[1])
        return loss, [W, U, V.astype(np.float32), p.sum(axis=(0, 1)).astype(np.float32)]

    def probabilities(self, texts: list[str]) -> np.ndarray:
        """(texts, L): the mean over all bytes of each text, none left out. A text without bytes has even probabilities."""
        codes = [np.frombuffer(t.encode(), np.uint8) for t in texts]
        sums, sizes = np.zeros((len(texts), len(self.labels))), np.array([len(c) for c in codes])
        rows = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), rows)
        x = np.full((int(rows.sum()), WINDOW), 256, np.int64)
        at = 0
        for c, n in zip(codes, rows):
            x[at : at + n].ravel()[: len(c)] = c
            at += n
        for low in range(0, len(x), TOGETHER):
            part = x[low : low + TOGETHER]
            p = self.logits(self.forward(part))
            p -= p.max(axis=-1, keepdims=True)
            np.exp(p, out=p)
            p /= p.sum(axis=-1, keepdims=True)
            p *= (part < 256).T[..., None]
            np.add.at(sums, owner[low : low + TOGETHER], p.sum(axis=0))
        return np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], 1 / max(1, len(self.labels)))


def train(windows: list[tuple[bytes, str]], labels: list[str], seed: int = SEED) -> Network:
    """A network fitted to (bytes, label) windows with Adam; windows of a label with few of them count up to RARE times."""
    net, r = Network(labels, seed=seed), np.random.default_rng(seed)
    x, weight = np.full((len(windows), WINDOW), 256, np.int64), np.zeros((len(windows), WINDOW), np.float32)
    for i, (code, _) in enumerate(windows):
        x[i, : len(code)], weight[i, : len(code)] = np.frombuffer(code, np.uint8), 1
    y = np.array([labels.index(label) for _, label in windows])
    counts = np.bincount(y, minlength=len(labels))
    weight *= np.minimum(RARE, counts.max() / np.maximum(counts, 1))[y][:, None].astype(np.float32)
    params = [net.W, net.U, net.V, net.b]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(EPOCHS):
        order = r.permutation(len(x))
        for low in range(0, len(x), BATCH):
            at = order[low : low + BATCH]
            step += 1
            for p, g, m, v in zip(params, net.gradients(x[at], y[at], weight[at])[1], first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def quotas(counts: dict[str, int], documents: int) -> dict[str, int]:
    """How many texts of each language to draw: an even part, and what languages with fewer leave is shared by the others."""
    out, left = {}, documents
    for k, (label, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        out[label] = min(n, max(1, left // (len(counts) - k)))
        left -= out[label]
    return out


def training_windows(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> list[tuple[bytes, str]]:
    """Windows of about `documents` different labelled texts that are not held out, as many of each language as there are.

    A text is drawn if its hash lies under its language's threshold, which follows from how many different texts that has; so
    what is gathered is bounded before it leaves the executors, copies count once, and a rare language is drawn whole. Windows are
    cut out at places spread over the whole text. Of more than LANGUAGES languages the most frequent are learned.
    """
    size = F.char_length("text")
    places = [F.pmod(F.xxhash64("text", F.lit(k)), F.greatest(size - WINDOW + 1, F.lit(1))) + 1 for k in range(SAMPLE_WINDOWS)]
    cuts = F.array_distinct(F.array(*[F.substring(F.col("text"), p.cast("int"), F.lit(WINDOW)) for p in places]))
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("text", F.lit(SEED)))
    found = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    counts = {r.lang: r.n for r in found if r.n}
    wanted = quotas(counts, documents)
    # a fifth and 20 more than wanted, as both the counts and the draws scatter; a threshold of all is one that draws all
    share = {label: min(1.0, (1.2 * wanted[label] + 20) / n) for label, n in counts.items()}
    rows = [(label, -(1 << 63) + min(int(p * (1 << 64)), (1 << 64) - 1)) for label, p in share.items()]
    limits = docs.sparkSession.createDataFrame(rows, "lang string, most long")
    drawn = known.join(F.broadcast(limits), "lang").filter(F.col("h") <= F.col("most")).select("h", "lang", cuts.alias("cuts"))
    once = drawn.groupBy("h", "lang").agg(F.min("cuts").alias("cuts")).collect()
    taken: dict[str, int] = {}
    out = []
    for r in sorted(once):
        taken[r.lang] = taken.get(r.lang, 0) + 1
        if taken[r.lang] <= wanted[r.lang]:
            out += [(c.encode()[:WINDOW], r.lang) for c in r.cuts if LETTER.search(c)]
    return out


def fit(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> Network | None:
    """None where nothing can be learned."""
    windows = training_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"), documents)
    labels = sorted({label for _, label in windows})
    return train(windows, labels) if labels else None


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, one row for each row of docs; only texts are looked at.

    lang_pred is `und` with score 0 if the text is null or has no letter, or if nothing was learned. Narrow: no shuffle; whole
    texts, TOGETHER windows at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            low = 0
            while low < len(texts):
                high, n = low, 0
                while high < len(texts) and n < 1_000_000:
                    n += len(texts[high] or "")
                    high += 1
                part = texts[low:high]
                use = [i for i, t in enumerate(part) if network and t and LETTER.search(t)]
                names, scores = ["und"] * len(part), [0.0] * len(part)
                if use:
                    p = network.probabilities([part[i] for i in use])
                    for i, k, s in zip(use, p.argmax(axis=1), p.max(axis=1)):
                        names[i], scores[i] = network.labels[k], min(1.0, float(s))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(low, len(part)) for c in ("doc_id", "held_out")] + [pa.array(names), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])
                low = high

    few = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    return few.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
