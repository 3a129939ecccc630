"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and applied in numpy.

A word's input is the sum of its own vector (for the words frequent in the training sample) and of its character n-grams'
mean vector (hashed, with the word's start and end marked). The network reads overlapping windows of `WIDTH` words, one each
`STRIDE` words, over the whole text; attention pools each window's states, and a document's score is its highest window's.

Labels belong to documents, not to windows: training first takes all windows of toxic documents as toxic, then, pass by
pass, those that score high, against the highest of each clean document and a random choice of others.

Inference is one pass over the texts without a shuffle; the model goes to the tasks with the function. What a worker keeps
is bounded: one chunk of windows and the input projections of `KEPT` words.

Defined results: null and empty texts, and texts without letters, have the score of an empty window; runs of letters over
24 are read in pieces of 24; repeated rows have equal scores; without any labelled row of both classes all scores are the
share of toxic labels (0 without labels); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import count
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import doc_fold
from lexmill.llm.labelled import sample

#: Chosen by cross-validation inside the learnable folds; a passage of up to WIDTH - STRIDE + 1 words lies whole in a window.
WIDTH, STRIDE = 16, 8
VECTOR, STATE, ATTENTION = 16, 8, 8
GRAMS, VOCABULARY = 8192, 3000
#: Bounds of the sample of labelled rows: clean and toxic rows, and characters of a row.
PER_CLASS, MOST_CHARS = (2_700, 900), 20_000
#: One row of so many in the sample sets the threshold and is not trained on.
CALIBRATE = 4
#: The share of toxic documents that the threshold is set for.
TOXIC_SHARE = 0.1
PASSES, BATCH, RATE = 7, 256, 0.01
#: A small sample is gone over again until so many batches are done.
LEAST_BATCHES = 360
KEPT = 120_000
CHUNK = 2048
LETTERS = 24
_WORD = re.compile(r"[^\W\d_]{1,24}")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (3 to 5 letters, marked at the ends) of all words one after another, and where each word's begin."""
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    width = int(lengths.max()) if words else 2
    marked = "".join([f"^{w}$".ljust(width, "\0") for w in words])
    codes = np.frombuffer(marked.encode("utf-32-le"), dtype=np.uint32).reshape(len(words), width).astype(np.uint64)
    out, valid = [], []
    rolling = np.zeros_like(codes)
    for n in range(1, min(5, codes.shape[1]) + 1):
        width = codes.shape[1] - n + 1
        rolling = rolling[:, :width] * np.uint64(0x100000001B3) + codes[:, n - 1 : n - 1 + width] * np.uint64(0x9E3779B97F4A7C15)
        if n > 2:
            mixed = rolling ^ (rolling >> np.uint64(29))
            out.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) % np.uint64(GRAMS))
            valid.append(np.arange(width)[None, :] < (lengths - n + 1)[:, None])
    grams, valid = np.concatenate(out, 1).astype(np.int32), np.concatenate(valid, 1)
    counts = valid.sum(1)
    return grams[valid], np.concatenate([[0], np.cumsum(counts)[:-1]])


def summed(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """(n, width): the rows of each place `at`, added up."""
    out = np.zeros((n, rows.shape[1]), dtype=rows.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        out[at[order[first]]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Network:
    """Parameters, the forward pass over windows of word rows, and its gradients."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p: dict[str, np.ndarray] = {
            "words": draw(len(vocabulary) + 1, VECTOR, scale=0.1),
            "grams": draw(GRAMS, VECTOR, scale=0.3),
            "input": draw(2, VECTOR, 3 * STATE, scale=VECTOR**-0.5),
            "state": draw(2, STATE, 3 * STATE, scale=STATE**-0.5),
            "bias": np.zeros((2, 1, 3 * STATE), dtype=np.float32),
            "attend": draw(2 * STATE, ATTENTION, scale=(2 * STATE) ** -0.5),
            "query": draw(ATTENTION, scale=1.0),
            "out": draw(2 * STATE, scale=0.5),
            "out_bias": np.full(1, -1.0, dtype=np.float32),
        }
        self.p["words"][0] = 0

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """The input vectors of words, and what their gradient needs."""
        grams, starts = grams_of(words)
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        counts = np.diff(np.append(starts, len(grams))).astype(np.float32)
        mean = np.add.reduceat(self.p["grams"][grams], starts, axis=0) / counts[:, None]
        return self.p["words"][ids] + mean, (grams, counts, ids)

    def projected(self, vectors: np.ndarray) -> np.ndarray:
        """(2, words, 3 * STATE): the part of the gates that the words give; row 0 is the padding."""
        return np.concatenate([np.zeros((2, 1, 3 * STATE), dtype=np.float32), vectors @ self.p["input"] + self.p["bias"]], 1)

    def forward(self, projected: np.ndarray, rows: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple | None]:
        """Logits of windows; rows (windows, WIDTH) point into `projected`, 0 beyond a window's words."""
        n, width = rows.shape
        state = self.p["state"]
        h = np.zeros((2, n, STATE), dtype=np.float32)
        hidden = np.empty((width, 2, n, STATE), dtype=np.float32)
        mask = (rows > 0).astype(np.float32)
        saved = []
        for t in range(width):
            back = width - 1 - t
            gates = np.stack([projected[0, rows[:, t]], projected[1, rows[:, back]]])
            own = h @ state
            zr = 0.5 * np.tanh(0.5 * (gates[..., : 2 * STATE] + own[..., : 2 * STATE])) + 0.5
            z, r = zr[..., :STATE], zr[..., STATE:]
            new = np.tanh(gates[..., 2 * STATE :] + r * own[..., 2 * STATE :])
            m = np.stack([mask[:, t], mask[:, back]])[..., None]
            move = (1 - z) * m
            before = h
            h = h + move * (new - h)
            hidden[t, 0], hidden[back, 1] = h[0], h[1]
            if keep:
                saved.append((before, z, r, new, own[..., 2 * STATE :], m))
        both = np.concatenate([hidden[:, 0], hidden[:, 1]], -1)  # width, n, 2 * STATE
        seen = np.tanh(both @ self.p["attend"])
        score = seen @ self.p["query"] + np.where(mask.T > 0, 0, -1e9).astype(np.float32)
        weight = np.exp(score - score.max(0))
        weight *= mask.T
        weight /= np.maximum(weight.sum(0), 1e-9)
        pooled = (weight[..., None] * both).sum(0)
        logits = pooled @ self.p["out"] + self.p["out_bias"][0]
        return logits, (saved, both, seen, weight, pooled) if keep else None

    def backward(self, rows: np.ndarray, kept: tuple, slope: np.ndarray, words: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters that the forward pass used, and of the projected rows; slope: d loss / d logit."""
        saved, both, seen, weight, pooled = kept
        g: dict[str, np.ndarray] = {"out": pooled.T @ slope, "out_bias": np.array([slope.sum()], dtype=np.float32)}
        d_pooled = slope[:, None] * self.p["out"]
        d_weight = (d_pooled[None] * both).sum(-1)
        d_both = weight[..., None] * d_pooled[None]
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        g["query"] = np.einsum("tna,tn->a", seen, d_score)
        d_seen = d_score[..., None] * self.p["query"] * (1 - seen**2)
        g["attend"] = np.einsum("tnh,tna->ha", both, d_seen)
        d_both += d_seen @ self.p["attend"].T
        n, width = rows.shape
        state = self.p["state"]
        g["state"] = np.zeros_like(state)
        d_rows = np.empty((2, width, n, 3 * STATE), dtype=np.float32)
        d_h = np.zeros((2, n, STATE), dtype=np.float32)
        for t in range(width - 1, -1, -1):
            back = width - 1 - t
            before, z, r, new, own_n, m = saved[t]
            d_h += np.stack([d_both[t, :, :STATE], d_both[back, :, STATE:]])
            d_new = d_h * (1 - z) * m * (1 - new**2)
            d_z = d_h * (before - new) * m * z * (1 - z)
            d_own_n = d_new * r
            d_r = d_new * own_n * r * (1 - r)
            d_own = np.concatenate([d_z, d_r, d_own_n], -1)
            d_gates = np.concatenate([d_z, d_r, d_new], -1)
            d_rows[0, t], d_rows[1, back] = d_gates
            g["state"] += before.transpose(0, 2, 1) @ d_own
            d_h = d_h * (1 - (1 - z) * m) + d_own @ state.transpose(0, 2, 1)
        # Sums by row, of rows brought together; each row occurs, and 0 is the padding.
        flat = rows.T.ravel()
        order = np.argsort(flat, kind="stable")
        starts = np.flatnonzero(np.diff(flat[order], prepend=-1))
        d_projected = np.zeros((2, words + 1, 3 * STATE), dtype=np.float32)
        d_projected[:, flat[order[starts]]] = np.add.reduceat(d_rows.reshape(2, -1, 3 * STATE)[:, order], starts, axis=1)
        return g, d_projected[:, 1:]


def window_rows(rows: np.ndarray) -> np.ndarray:
    """All windows of a document's word rows; a text without words has one empty window."""
    n = max(1, -(-(len(rows) - WIDTH) // STRIDE) + 1) if len(rows) else 1
    padded = np.zeros((n - 1) * STRIDE + WIDTH, dtype=np.int64)
    padded[: len(rows)] = rows
    return np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[::STRIDE]


def fit(texts: list[str], labels: list[int], seed: int = 7, passes: int = PASSES) -> Network:
    """The network trained on whole texts with labels 0 and 1, by Adam."""
    split = [words_of(t) for t in texts]
    y = np.array(labels)
    number: Counter[str] = Counter()
    for own in split:
        number.update(set(own))
    vocabulary = {w: k for k, (w, _) in enumerate(sorted(number.items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY], 1)}
    net = Network(vocabulary, seed)
    every = sorted(number)
    place = {w: k for k, w in enumerate(every, 1)}
    windows, owner = [], []
    for k, own in enumerate(split):
        rows = window_rows(np.fromiter((place[w] for w in own), dtype=np.int64, count=len(own)))
        windows.append(rows)
        owner += [k] * len(rows)
    windows, owner = np.concatenate(windows), np.array(owner)
    positive = y[owner] == 1
    r = np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    clean = np.flatnonzero(~positive)
    for turn in count():
        if turn >= passes and step >= LEAST_BATCHES:
            break
        toxic, hard = np.flatnonzero(positive), clean[:0]
        if turn:  # of a toxic document the highest window and all that are surely toxic, of a clean one the highest
            logits = net_logits(net, every, windows)
            best = np.full(len(y), -np.inf)
            np.maximum.at(best, owner, logits)
            toxic = toxic[logits[toxic] >= np.minimum(best[owner[toxic]], 1.0) - 1e-6]
            hard = clean[logits[clean] >= best[owner[clean]] - 1e-6]
        some = np.union1d(hard, r.permutation(clean)[: max(len(toxic), 3000)])
        order = r.permutation(np.concatenate([toxic, some]))
        target = np.isin(order, toxic).astype(np.float32)
        for first in range(0, len(order), BATCH):
            at, t = order[first : first + BATCH], target[first : first + BATCH]
            used, rows = np.unique(windows[at], return_inverse=True)
            rows = rows.reshape(windows[at].shape)
            if used[0] != 0:
                used, rows = np.concatenate([[0], used]), rows + 1
            vectors, (grams, counts, ids) = net.vectors([every[k - 1] for k in used[1:]]) if len(used) > 1 else (np.zeros((0, VECTOR), np.float32), (np.zeros(0, int), np.zeros(0), np.zeros(0, int)))
            logits, kept = net.forward(net.projected(vectors), rows, keep=True)
            slope = ((1 / (1 + np.exp(-logits)) - t) / len(at)).astype(np.float32)
            g, d_projected = net.backward(rows, kept, slope, len(used) - 1)
            g["input"] = vectors.T[None] @ d_projected
            g["bias"] = d_projected.sum(1, keepdims=True)
            d_vectors = (d_projected @ net.p["input"].transpose(0, 2, 1)).sum(0)
            g["words"] = summed(d_vectors, ids, len(net.p["words"]))
            g["words"][0] = 0
            g["grams"] = summed(np.repeat(d_vectors / np.maximum(counts, 1)[:, None], counts.astype(int), axis=0), grams, GRAMS)
            step += 1
            for k, v in net.p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def calibrate(net: Network, texts: list[str], labels: list[int], toxic_share: float) -> None:
    """Move the output so that 0.5 makes the fewest errors at the given share of toxic documents; ties: the middle."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return
    logits = Scorer(net).logits(texts)
    order = np.argsort(logits, kind="stable")
    # Errors with a cut after k documents: toxic ones below it and clean ones above it.
    missed = np.concatenate([[0], np.cumsum(y[order])]) / y.sum() * toxic_share
    raised = (1 - np.concatenate([[0], np.cumsum(1 - y[order])]) / (1 - y).sum()) * (1 - toxic_share)
    edges = np.concatenate([[logits.min() - 2], logits[order], [logits.max() + 2]])
    least = np.flatnonzero(missed + raised <= (missed + raised).min() + 1e-12)
    net.p["out_bias"] -= np.float32((edges[least[0]] + edges[least[-1] + 1]) / 2)


def net_logits(net: Network, words: list[str], windows: np.ndarray) -> np.ndarray:
    projected = net.projected(net.vectors(words)[0]) if words else np.zeros((2, 1, 3 * STATE), np.float32)
    return np.concatenate([net.forward(projected, windows[k : k + CHUNK])[0] for k in range(0, len(windows), CHUNK)])


class Scorer:
    """Scores of texts: the highest window's, with the words' projections kept between calls."""

    def __init__(self, net: Network):
        self.net = net
        self._empty()

    def _empty(self) -> None:
        self.place: dict[str, int] = {}
        self.projected = np.zeros((2, 1024, 3 * STATE), dtype=np.float32)

    def _learn(self, new: list[str]) -> None:
        first = len(self.place) + 1
        rows = self.net.projected(self.net.vectors(new)[0])[:, 1:]
        room = self.projected.shape[1]
        while room < first + len(new):
            room *= 2
        if room > self.projected.shape[1]:
            grown = np.zeros((2, room, 3 * STATE), dtype=np.float32)
            grown[:, :first] = self.projected[:, :first]
            self.projected = grown
        self.projected[:, first : first + len(new)] = rows
        self.place.update(zip(new, range(first, first + len(new)), strict=True))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.logits(texts)))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        held, owners, count = [], [], 0

        def flush() -> None:
            nonlocal held, owners, count
            if held:
                windows, owner = np.concatenate(held), np.concatenate(owners)
                for k in range(0, len(windows), CHUNK):
                    np.maximum.at(best, owner[k : k + CHUNK], self.net.forward(self.projected, windows[k : k + CHUNK])[0])
            held, owners, count = [], [], 0

        for first in range(0, len(texts), 256):
            group = [words_of(t) for t in texts[first : first + 256]]
            if len(self.place) > KEPT:
                flush()
                self._empty()
            new = list(set().union(*group).difference(self.place))
            for k in range(0, len(new), 4096):
                self._learn(new[k : k + 4096])
            for k, own in enumerate(group, first):
                rows = window_rows(np.fromiter(map(self.place.__getitem__, own), dtype=np.int64, count=len(own)))
                held.append(rows)
                owners.append(np.full(len(rows), k))
                count += len(rows)
                if count >= CHUNK:
                    flush()
            flush()
        return best


def _score(net: Any, prior: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(net) if net else None
        for frame in frames:
            frame["score"] = scorer(frame["text"].tolist()) if scorer else prior
            yield frame.drop(columns="text")

    return score


def trained(rows: list[tuple[str, int]]) -> Network | None:
    """The network of a sample of (text, label), fitted on one part and calibrated on the other; None without both classes."""
    part = [k % CALIBRATE == CALIBRATE - 1 for k in range(len(rows))]
    learn, hold = [[r for r, p in zip(rows, part, strict=True) if p == want] for want in (False, True)]
    if len({y for _, y in learn}) < 2:
        return None
    net = fit([t for t, _ in learn], [y for _, y in learn])
    calibrate(net, [t for t, _ in hold], [y for _, y in hold], TOXIC_SHARE)
    return net


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, per_class: tuple[int, int] = PER_CLASS, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Labels of the held fold are not learned from."""
    rows = sample(docs, labels, "toxic", doc_fold(F.col("doc_id"), folds) != held, per_class, most_chars)
    net = trained(rows)
    prior = sum(y for _, y in rows) / len(rows) if rows else 0.0
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(doc_fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = clean.mapInPandas(_score(net, prior), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
