"""Document quality by a linear-chain conditional random field over lines.

Each line has numbers that describe it (lengths, capitals, signs, repetition), cut into bins at the sample's quantiles. A
line's evidence is a sum of weights of its own bins and of the bins of the lines before and after it; two more weights tie
the labels (good, bad) of adjacent lines. Forward-backward gives each line's probability of being bad, as two recursions on
log-odds; a document's share of bad text is their mean weighed by length, and a logistic curve turns it into a score.

Labels belong to documents. The field is first fitted with each line labelled as its document; then lines of bad documents
that the field takes for good, without their neighbours' help, are labelled good, and it is fitted again.

Inference is one pass over the texts without a shuffle; the model, some hundred weights, goes to the tasks with the
function. Memory is bounded by a group of `GROUP_CHARS` characters or one document.

Defined results: null and empty texts, and texts of white space, count as one empty line; lines without words are left out
beside others; repeated rows have equal scores; without any labelled row of both classes all scores are the share of good
labels (1 without labels, so nothing is rejected); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.common import doc_fold, tidy
from lexmill.llm.labelled import sample

#: Bounds of the sample of labelled rows: bad and good rows, and characters of a row.
PER_CLASS, MOST_CHARS = (1_200, 2_400), 20_000
#: Parts of the sample; each is scored by a field fitted on the others, to set the curve.
PARTS = 3
#: The share of bad documents that the curve is set for.
BAD_SHARE = 0.14
BINS = 8
#: The decay of weights is for one document; it falls with their number.
PASSES, RATE, DECAY = 100, 0.08, 2.0
GROUP_CHARS = 1 << 21
FEATURES = ("chars", "words", "word_length", "upper", "digit", "sign", "loud", "bare_signs", "distinct", "adjacent", "top", "ended", "sentence", "repeated_line")

_SPACE, _UPPER, _LOWER, _DIGIT, _SIGN, _LOUD = range(6)


def _classes() -> np.ndarray:
    """The class of each code point below 65536; those above count as signs."""
    out = np.full(1 << 16, _SIGN, dtype=np.uint8)
    for code in range(1 << 16):
        c = chr(code)
        if c.isspace():
            out[code] = _SPACE
        elif c.isalpha():
            out[code] = _UPPER if c.isupper() else _LOWER
        elif c.isdigit():
            out[code] = _DIGIT
    out[[ord(c) for c in "!|#$%&*@~^<>{}[]=_\\"]] = _LOUD
    return out


_CLASS = _classes()


def lines_of(text: str | None) -> list[str]:
    """The lines that hold words; one empty line if there is none."""
    return [x for x in text.splitlines() if x and not x.isspace()] or [""] if text else [""]


def features(lines: list[str], sizes: list[int]) -> np.ndarray:
    """A row of numbers for each line; sizes: how many lines each document has."""
    n = len(lines)
    codes = np.frombuffer("\n".join([*lines, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in lines])[:-1]])
    kind = _CLASS[np.minimum(codes, 0xFFFF)]
    count = lambda k: np.add.reduceat((kind == k).astype(np.int32), starts)
    upper, lower, digit, sign, loud = (count(k) for k in (_UPPER, _LOWER, _DIGIT, _SIGN, _LOUD))
    chars = np.array([len(x) for x in lines])
    shown = np.maximum(1, chars)
    own = np.empty((6, n))
    for k, line in enumerate(lines):
        words = line.split()
        m = len(words)
        if not m:
            own[:, k] = 0
            continue
        seen = Counter(words)
        own[0, k], own[1, k] = m, len(seen) / m
        own[2, k] = sum(map(eq, words, words[1:])) / m
        own[3, k] = max(seen.values()) / m
        own[4, k] = sum(v for w, v in seen.items() if len(w) < 3 and not w.isalnum()) / m
        own[5, k] = line.rstrip()[-1] in ".?!。"
    stops = np.add.reduceat(((codes == 46) | (codes == 63) | (codes == 0x3002)).astype(np.int32), starts)
    repeated = np.zeros(n)
    at = 0
    for size in sizes:
        if size > 1:
            seen = Counter(lines[at : at + size])
            if len(seen) < size:
                repeated[at : at + size] = [seen[x] > 1 for x in lines[at : at + size]]
        at += size
    words = own[0]
    columns = [
        np.log1p(chars), np.log1p(words), (upper + lower + digit) / np.maximum(1, words), upper / np.maximum(1, upper + lower), digit / shown, sign / shown, loud / shown,
        own[4], own[1], own[2], own[3], own[5], np.log1p(words / (1 + stops)), repeated,
    ]
    return np.stack(columns, 1)


class Chains:
    """Documents as chains of lines, worked on side by side: at each step all that are long enough."""

    def __init__(self, sizes: np.ndarray):
        order = np.argsort(-sizes, kind="stable")
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])[order]
        live = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max(initial=0))), side="right")
        self.steps = [starts[:k] + t for t, k in enumerate(live)]
        self.sizes, n = sizes, int(sizes.sum())
        self.first = np.zeros(n, dtype=bool)
        self.first[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int)] = True
        self.last = np.roll(self.first, -1)

    def forward_backward(self, evidence: np.ndarray, stay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of bad from the lines up to each (with it), and from those after it; stay: weights of good-good and bad-bad."""
        good, bad = float(stay[0]), float(stay[1])
        ahead, behind = np.empty_like(evidence), np.zeros_like(evidence)
        for t, at in enumerate(self.steps):
            ahead[at] = evidence[at]
            if t:
                m = ahead[at - 1]
                ahead[at] += np.logaddexp(0, bad + m) - np.logaddexp(good, m)
        for at in self.steps[:0:-1]:
            m = evidence[at] + behind[at]
            behind[at - 1] = np.logaddexp(0, bad + m) - np.logaddexp(good, m)
        return ahead, behind


class Field:
    """Bin edges, weights (own, before, after; feature; bin), and the weights of equal neighbours."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        # The last bin is that of a line beyond the document's ends.
        self.p = {"weights": np.zeros((3, len(edges), BINS + 1)), "bias": np.zeros(1), "stay": np.zeros(2)}
        self.slope, self.middle = 8.0, 0.5

    def bins(self, x: np.ndarray, chains: Chains) -> np.ndarray:
        """(3, lines, features): bins of each line and of its neighbours."""
        own = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], 1)
        before, after = np.roll(own, 1, 0), np.roll(own, -1, 0)
        before[chains.first] = BINS
        after[chains.last] = BINS
        return np.stack([own, before, after])

    def evidence(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(bins.shape[1], self.p["bias"][0])
        for side in range(3):
            for f in range(bins.shape[2]):
                out += self.p["weights"][side, f][bins[side, :, f]]
        return out

    def share_bad(self, lines: list[str], sizes: np.ndarray) -> np.ndarray:
        """Each document's length-weighted mean of its lines' probabilities of being bad."""
        chains = Chains(sizes)
        ahead, behind = chains.forward_backward(self.evidence(self.bins(features(lines, sizes.tolist()), chains)), self.p["stay"])
        weight = np.array([len(x) + 1.0 for x in lines])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        return np.add.reduceat(weight * _logistic(ahead + behind), starts) / np.add.reduceat(weight, starts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The probability that each text is good."""
        out, lines, sizes, held = [], [], [], 0
        for k, text in enumerate(texts, 1):
            own = lines_of(text)
            lines += own
            sizes.append(len(own))
            held += len(text or "")
            if held > GROUP_CHARS or k == len(texts):
                out.append(_logistic(self.slope * (self.middle - self.share_bad(lines, np.array(sizes)))))
                lines, sizes, held = [], [], 0
        return np.concatenate(out) if out else np.empty(0)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _ascend(field: Field, bins: np.ndarray, chains: Chains, y: np.ndarray, weight: np.ndarray, passes: int) -> None:
    """Adam on the weighed log-likelihood of line labels."""
    decay = DECAY / len(chains.sizes)
    inner = np.flatnonzero(~chains.last)
    total = weight.sum()
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in field.p.items()}
    for step in range(1, passes + 1):
        evidence = field.evidence(bins)
        ahead, behind = chains.forward_backward(evidence, field.p["stay"])
        slope = (_logistic(ahead + behind) - y) * weight / total
        g = {"bias": np.array([slope.sum()]), "weights": np.empty_like(field.p["weights"]), "stay": np.zeros(2)}
        for side in range(3):
            for f in range(bins.shape[2]):
                g["weights"][side, f] = np.bincount(bins[side, :, f], slope, BINS + 1)
        # Pairs of neighbours: the probabilities that both are good, and both bad.
        m, b, (good, bad) = ahead[inner], evidence[inner + 1] + behind[inner + 1], field.p["stay"]
        odds = np.stack([np.full(len(inner), good), b, m, m + b + bad])
        odds = np.exp(odds - odds.max(0))
        odds /= odds.sum(0)
        w = weight[inner] / total
        g["stay"][0] = (w * (odds[0] - (1 - y[inner]) * (1 - y[inner + 1]))).sum()
        g["stay"][1] = (w * (odds[3] - y[inner] * y[inner + 1])).sum()
        for k, v in field.p.items():
            g[k] += decay * v
            a, s = moments[k]
            a += 0.1 * (g[k] - a)
            s += 0.01 * (g[k] ** 2 - s)
            v -= RATE * (a / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)


class Lines:
    """The lines of documents, and their number in each."""

    def __init__(self, texts: list[str]):
        split = [lines_of(t) for t in texts]
        self.all, self.sizes = [x for own in split for x in own], np.array([len(x) for x in split])


def fit(rows: list[tuple[str, int]], passes: int = PASSES) -> Field:
    """The field of a sample of (text, quality) with both classes, its curve unset."""
    lines, bad = Lines([t for t, _ in rows]), np.array([1 - q for _, q in rows], dtype=float)
    sizes = lines.sizes
    x = features(lines.all, sizes.tolist())
    field = Field([np.unique(np.quantile(x[:, f], np.arange(1, BINS) / BINS)) for f in range(x.shape[1])])
    chains = Chains(sizes)
    bins = field.bins(x, chains)
    # A document counts once, however many lines it has; both classes count alike.
    y = np.repeat(bad, sizes)
    weight = np.repeat(1 / sizes / np.where(bad == 1, bad.sum(), (1 - bad).sum()), sizes)
    _ascend(field, bins, chains, y, weight, passes)
    relabelled = np.where(field.evidence(bins) < -1, 0.0, y)
    still = np.repeat(np.add.reduceat(relabelled, np.concatenate([[0], np.cumsum(sizes)[:-1]])) > 0, sizes)
    _ascend(field, bins, chains, np.where(still, relabelled, y), weight, passes)
    return field


def threshold(share: np.ndarray, bad: np.ndarray) -> float:
    """Where the share of bad text parts the classes with the fewest errors at `BAD_SHARE`; of equal places, the middle."""
    order = np.argsort(share, kind="stable")
    missed = np.concatenate([[0], np.cumsum(bad[order])]) / bad.sum() * BAD_SHARE
    raised = (1 - np.concatenate([[0], np.cumsum(1 - bad[order])]) / (1 - bad).sum()) * (1 - BAD_SHARE)
    edges = np.concatenate([[0.0], share[order], [1.0]])
    least = np.flatnonzero(missed + raised <= (missed + raised).min() + 1e-12)
    return float(edges[least[0]] + edges[least[-1] + 1]) / 2


def learned(rows: list[tuple[str, int]]) -> Field | None:
    """The field of a whole sample, its curve set by parts that were not trained on; None without both classes."""
    bad = np.array([1 - q for _, q in rows])
    if len(set(bad.tolist())) < 2:
        return None
    share, part = np.full(len(rows), np.nan), np.arange(len(rows)) % PARTS
    for k in range(PARTS):
        learn, own = [r for r, p in zip(rows, part, strict=True) if p != k], [t for (t, _), p in zip(rows, part, strict=True) if p == k]
        if own and len({q for _, q in learn}) == 2:
            lines = Lines(own)
            share[part == k] = fit(learn).share_bad(lines.all, lines.sizes)
    field = fit(rows)
    known = ~np.isnan(share)
    if len(set(bad[known].tolist())) == 2:
        field.middle = threshold(share[known], bad[known])
    return field


def _score(field: Field | None, prior: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["score"] = field.scores(frame["text"].tolist()) if field else prior
            yield frame.drop(columns="text")

    return score


def trained(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_class: tuple[int, int] = PER_CLASS, most_chars: int = MOST_CHARS) -> tuple[Field | None, float]:
    """The field learned from the labels outside the held fold, and the share of good labels in its sample."""
    rows = sample(docs, labels, "quality", doc_fold(F.col("doc_id"), folds) != held, per_class, most_chars)
    return learned(rows), sum(q for _, q in rows) / len(rows) if rows else 1.0


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, per_class: tuple[int, int] = PER_CLASS, most_chars: int = MOST_CHARS) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted. Labels of the held fold are not learned from."""
    field, prior = trained(docs, labels, folds, held, per_class, most_chars)
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(doc_fold(F.col("doc_id"), folds) == held, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = clean.mapInPandas(_score(field, prior), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that are predicted good, with all their columns as they are; texts are scored where they lie."""
    field, prior = trained(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            scores = field.scores(texts) if field else np.full(len(texts), prior)
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(tidy(keep), docs.schema)
