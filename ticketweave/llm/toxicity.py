"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels come per document, so tokens are labelled first: Spark counts in how many toxic and clean training documents each word
and word beginning occurs, and those that set toxic documents apart mark their tokens. A two-state chain over windows of
tokens is then fitted by its exact gradient (forward-backward) on a bounded set of windows. Scoring runs one chain over all
tokens of a text, however long; a document's score is the chance that at least one of its tokens is toxic.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketweave.llm.common import let, settle, small_batches

#: Documented bounds of the training sample: labelled documents of each class, and windows of tokens the field is fitted on.
SAMPLE_DOCS, SAMPLE_WINDOWS = 20_000, 12_000
WINDOW, BUCKETS = 64, 1 << 18
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|«»“”‘’…-–_/\\=+~`^@"
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")


def features(word: str) -> list[str]:
    """A word and its beginnings; beginnings let unseen endings of a known family count."""
    return ["w" + word, *[f"{n}{word[:n]}" for n in (4, 5, 6) if len(word) > n]]


def bucket(feature: str) -> int:
    return zlib.crc32(feature.encode()) % BUCKETS


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def forward_backward(emission: np.ndarray, log_step: np.ndarray, log_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of windows x tokens scores of state 1 against 0: odds of state 1 forward and backward, marginals, and step ratios.

    With two states the ratio of the two forward (backward) values carries all there is, so nothing under- or overflows.
    """
    e = np.exp(np.clip(emission, -40, 40))
    (s00, s01), (s10, s11) = np.exp(log_step)
    ahead, back = np.empty_like(e), np.ones_like(e)
    ahead[:, 0] = e[:, 0] * np.exp(log_start[1] - log_start[0])
    for t in range(1, e.shape[1]):
        r = ahead[:, t - 1]
        ahead[:, t] = e[:, t] * (s01 + s11 * r) / (s00 + s10 * r)
    for t in range(e.shape[1] - 2, -1, -1):
        r = e[:, t + 1] * back[:, t + 1]
        back[:, t] = (s10 + s11 * r) / (s00 + s01 * r)
    odds = ahead * back
    return ahead, back, odds / (1 + odds), e


def chain_marginals(emissions: list[np.ndarray], log_step: np.ndarray, log_start: np.ndarray, width: int = WINDOW) -> list[np.ndarray]:
    """Marginals of state 1 of whole chains of any length, one array for each array of emissions.

    Chains are laid out as rows of ``width`` tokens, so that every step runs over all rows at once. What a row does to the odds
    that enter it is a product of two-by-two matrices; these carry the odds from row to row, forward and backward, and the
    rows are then run with the odds at their edges. The start scores act on a chain's first token only.
    """
    counts = np.array([-(-len(x) // width) for x in emissions], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    real = np.zeros((int(counts.sum()), width), dtype=bool)
    e = np.ones(real.shape)
    for x, at, n in zip(emissions, first, counts):
        real[at:at + n].reshape(-1)[:len(x)] = True
        e[at:at + n].reshape(-1)[:len(x)] = np.exp(np.clip(x, -40, 40))
    step = np.exp(log_step)
    (s00, s01), (s10, s11) = step
    prior, tail = np.full(len(e), np.exp(log_start[1] - log_start[0])), np.ones(len(e))
    long = np.flatnonzero(counts > 1)
    if len(long):
        rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in long])
        place = np.empty(len(e), dtype=np.int64)
        place[rows] = np.arange(len(rows))
        onward, backward = (np.tile(np.eye(2), (len(rows), 1, 1)) for _ in range(2))
        for t in range(width):
            seen = np.stack([np.ones(len(rows)), e[rows, t]], -1)
            onward = (step.T * seen[:, None, :]) @ onward
            onward /= onward.max(axis=(1, 2), keepdims=True)
        for t in range(width - 1, -1, -1):
            seen = np.stack([np.ones(len(rows)), e[rows, t]], -1)
            moved = (step * seen[:, None, :]) @ backward
            backward = np.where(real[rows, t, None, None], moved / moved.max(axis=(1, 2), keepdims=True), backward)
        long = long[np.argsort(-counts[long], kind="stable")]
        begin, end = first[long], first[long] + counts[long] - 1
        for k in range(1, int(counts[long[0]])):
            n = int((counts[long] > k).sum())
            at = begin[:n] + k
            m, q = onward[place[at - 1]], prior[at - 1]
            prior[at] = (m[:, 1, 0] + m[:, 1, 1] * q) / (m[:, 0, 0] + m[:, 0, 1] * q)
            at = end[:n] - k
            m, q = backward[place[at + 1]], tail[at + 1]
            tail[at] = (m[:, 1, 0] + m[:, 1, 1] * q) / (m[:, 0, 0] + m[:, 0, 1] * q)
    ahead, back = np.empty_like(e), np.empty_like(e)
    ahead[:, 0] = e[:, 0] * prior
    for t in range(1, width):
        r = ahead[:, t - 1]
        ahead[:, t] = e[:, t] * (s01 + s11 * r) / (s00 + s10 * r)
    back[:, -1] = tail
    for t in range(width - 2, -1, -1):
        r = e[:, t + 1] * back[:, t + 1]
        back[:, t] = np.where(real[:, t + 1], (s10 + s11 * r) / (s00 + s01 * r), tail)
    odds = ahead * back
    out = odds / (1 + odds)
    return [out[at:at + n].reshape(-1)[:len(x)] for x, at, n in zip(emissions, first, counts)]


@dataclass
class Field:
    """Weights of hashed features for state 1, a bias, and the chain's start and step scores; a fixed size."""

    weights: np.ndarray
    bias: float
    step: np.ndarray
    start: np.ndarray

    def emission(self, word: str) -> float:
        return self.bias + float(sum(self.weights[bucket(f)] for f in features(word)))


def fit_field(windows: list[tuple[list[str], list[int]]], epochs: int = 6, rate: float = 0.25, penalty: float = 1e-5, size: int = 256, seed: int = 3) -> Field:
    """Maximum likelihood with per-weight step sizes. A window is (words, labels); none at all give a field that finds nothing."""
    weights, bias, step, start = np.zeros(BUCKETS), -4.0, np.zeros((2, 2)), np.zeros(2)
    grown = [np.full(BUCKETS, 1e-3), 1e-3, np.full((2, 2), 1e-3), np.full(2, 1e-3)]
    order = np.random.default_rng(seed)
    longest = max((len(w) for w, _ in windows), default=1)
    coded = [([[bucket(f) for f in features(x)] for x in words], labels) for words, labels in windows]
    for _ in range(epochs):
        for at in range(0, len(coded), size):
            part = [coded[i] for i in order.permutation(len(coded))[:size]] if len(coded) > size else coded
            emission, labels, mask = np.full((len(part), longest), -40.0), np.zeros((len(part), longest)), np.zeros((len(part), longest))
            rows, cols, index = [], [], []
            for i, (ids, ys) in enumerate(part):
                labels[i, :len(ys)], mask[i, :len(ys)] = ys, 1
                for t, fs in enumerate(ids):
                    rows += [i] * len(fs)
                    cols += [t] * len(fs)
                    index += fs
            rows, cols, index = np.array(rows), np.array(cols), np.array(index)
            total = np.zeros_like(emission)
            np.add.at(total, (rows, cols), weights[index])
            emission = np.where(mask > 0, total + bias, -40.0)
            ahead, back, marginal, e = forward_backward(emission, step, start)
            off = (labels - marginal) * mask
            # Expected and seen steps between neighbours that both exist.
            both = mask[:, 1:] * mask[:, :-1]
            joint = np.empty((*both.shape, 2, 2))
            s = np.exp(step)
            right = e[:, 1:] * back[:, 1:]
            for a in (0, 1):
                left = ahead[:, :-1] if a else np.ones_like(both)
                joint[..., a, 0], joint[..., a, 1] = left * s[a, 0], left * s[a, 1] * right
            joint /= joint.sum(axis=(2, 3), keepdims=True)
            seen = np.stack([np.stack([(1 - labels[:, :-1] if a == 0 else labels[:, :-1]) * (1 - labels[:, 1:] if b == 0 else labels[:, 1:]) for b in (0, 1)], -1) for a in (0, 1)], -2)
            n = len(part)
            grads = [np.bincount(index, off[rows, cols], BUCKETS) / n - penalty * weights, off.sum() / n, ((seen - joint) * both[..., None, None]).sum((0, 1)) / n,
                     np.array([-off[:, 0].sum(), off[:, 0].sum()]) / n]
            for k, g in enumerate(grads):
                grown[k] = grown[k] + g * g
            weights = weights + rate * grads[0] / np.sqrt(grown[0])
            bias = bias + rate * grads[1] / np.sqrt(grown[1])
            step = step + rate * grads[2] / np.sqrt(grown[2])
            start = start + rate * grads[3] / np.sqrt(grown[3])
    return Field(weights, float(bias), step, start)


def _hash_order(key: Column) -> Column:
    return F.xxhash64(F.lit("toxicity"), key)


def _first_shingle(text: Column, seed: int) -> Column:
    """Smallest hash of three words in a row: near copies nearly always share it, other texts do not."""
    words = F.split(text, r"[\x20\x09-\x0D]+")
    return let(words, lambda w: F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.lit(seed), F.slice(w, i + 1, 3)))))


def training_sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = SAMPLE_DOCS) -> DataFrame:
    """(id, label, text) of at most ``most`` labelled documents of each class, in hash order of their keys.

    Of copies and near copies (found by their smallest shingle hashes) one is taken, so that a copied text counts once.
    """
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).cast("int").alias("label"))
    first = [marked.filter(F.col("label") == v).orderBy(_hash_order(F.col("id")), "id").limit(most) for v in (0, 1)]
    chosen = first[0].unionByName(first[1])
    found = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "id")
    found = settle(found.select("id", "label", "text", *[_first_shingle(F.col("text"), seed).alias(f"first{seed}") for seed in (1, 2, 3)]), "toxicity-found")
    ids = found.drop("text")
    for seed in (1, 2, 3):
        ids = ids.groupBy(f"first{seed}", "label").agg(F.min(F.struct("id", *[f"first{k}" for k in (1, 2, 3) if k > seed])).alias("r")).select("label", "r.*")
    return settle(found.join(ids.select("id", "label"), ["id", "label"], "left_semi").select("id", "label", "text"), "toxicity-sample")


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    def out():
        names = list(counts[0].keys() | counts[1].keys())
        rows = [pa.array(names, pa.string()), *[pa.array([c[x] for x in names], pa.int64()) for c in counts]]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(rows, names=["feature", "clean", "toxic"])

    for batch in batches:
        for label, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            words = {w.strip(_STRIP) for w in set(tokens(text))}
            counts[label].update({f for w in words if w for f in features(w)})
        if len(counts[0]) + len(counts[1]) > 500_000:
            yield out()
    yield out()


def marking_features(sample: DataFrame, precision: float = 0.95, sure: float = 0.65, z: float = 1.64) -> set[str]:
    """Features of toxic tokens: of the documents that hold one at least ``precision`` are toxic, and surely ``sure``.

    ``sure`` is met by the lower end of the share's confidence interval, so a feature seen in fewer than five documents marks
    nothing. The sample's bound also bounds what reaches the driver.
    """
    counts = sample.select("id", "label", "text").mapInArrow(_feature_counts, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    n, share = F.col("toxic") + F.col("clean"), F.col("toxic") / (F.col("toxic") + F.col("clean"))
    low = (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return {r[0] for r in counts.filter((F.col("toxic") > 0) & (share >= precision) & (low >= sure)).select("feature").collect()}


def training_windows(sample: DataFrame, marks: set[str], most: int = SAMPLE_WINDOWS) -> list[tuple[list[str], list[int]]]:
    """At most ``most`` windows of tokens with their labels: half with a marked token of a toxic document, half without one."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hit, words, labels = [], [], [], []
            for doc, label, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                found = [w.strip(_STRIP) for w in tokens(text)]
                for at in range(0, len(found), WINDOW):
                    part = found[at:at + WINDOW]
                    ys = [int(label == 1 and bool(w) and any(f in marks for f in features(w))) for w in part]
                    ids.append(zlib.crc32(f"{doc} {at}".encode()))
                    hit.append(any(ys))
                    words.append(part)
                    labels.append(ys)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hit, pa.bool_()), pa.array(words, pa.list_(pa.string())), pa.array(labels, pa.list_(pa.int32()))],
                                             names=["order", "hit", "words", "labels"])

    rows = sample.select("id", "label", "text").mapInArrow(cut, "order long, hit boolean, words array<string>, labels array<int>")
    # Unmarked windows are many: their share is set before they are ordered, from the count of documents alone.
    picked = [rows.filter(F.col("hit") == v).orderBy("order", "words").limit(most // 2) for v in (True, False)]
    return [(list(r[0]), list(r[1])) for r in picked[0].unionByName(picked[1]).select("words", "labels").collect()]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Field:
    """Fit on the labelled rows given; rows that are to be held out are not given."""
    small_batches(docs.sparkSession)
    sample = training_sample(docs, labels, key, text, label)
    return fit_field(training_windows(sample, marking_features(sample)))


class Scorer:
    """Scores batches of texts; a text is one chain over all its tokens."""

    def __init__(self, field: Field, limit: int = 400_000, least: float = 0.25):
        self.field, self.limit, self.least, self.known = field, limit, least, {}

    def _emissions(self, words: list[str]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, words), np.float32, len(words))
        except KeyError:
            if len(known) > self.limit:
                known.clear()
            for w in words:
                if w not in known:
                    core = w.strip(_STRIP)
                    known[w] = self.field.emission(core) if core else -40.0
            return np.fromiter(map(known.__getitem__, words), np.float32, len(words))

    def marginals(self, texts: list[str | None]) -> list[np.ndarray]:
        return chain_marginals([self._emissions(tokens(t)) for t in texts], self.field.step, self.field.start)

    def score(self, texts: list[str | None]) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """(score, offending (start, end, marginal) in code points) of each text."""
        out = []
        for text, m in zip(texts, self.marginals(texts)):
            m = np.where(m >= self.least, m, 0.0)  # what a very long text adds up from near-zero marginals is no evidence
            score = float(1.0 - np.exp(np.log1p(-np.minimum(m, 1 - 1e-9)).sum())) if len(m) else 0.0
            spans = []
            if len(m) and m.max() >= 0.5:
                places = [x.span() for x in re.finditer(r"\S+", text)]  # lower-casing makes and takes no white space
                spans = [(*places[i], float(m[i])) for i in np.flatnonzero(m >= 0.5)]
            out.append((min(1.0, max(0.0, score)), spans))
        return out


def toxicity(text: Column, field: Field, spark) -> Column:
    """struct<score, spans> of a text column; null and empty texts score 0 and have no spans. The field has a fixed size of 2 MB."""
    shared = spark.sparkContext.broadcast(field)

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            got = scorer.score(list(texts))
            yield pd.DataFrame({"score": [s for s, _ in got], "spans": [[{"start": a, "end": b, "marginal": m} for a, b, m in x] for _, x in got]})

    return run(text)


def held_out(key: Column) -> Column:
    """Rows that no label is learned from: crc32 of the key as text leaves 0 modulo 5."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted, spans.

    Null and empty texts score 0 and have no spans. Rows that repeat are scored each on its own text; equal texts score alike. A
    row with a null key is scored like any other and is not held out. Other columns, whatever their names, are not read. An empty
    table gives an empty result, and without toxic labels every score is near 0.
    """
    field = fit(docs, labels.filter(~held_out(F.col(key))), key, text, label)
    scored = docs.select(F.col(key).alias("doc_id"), held_out(F.col(key)).alias("held_out"), toxicity(F.col(text), field, docs.sparkSession).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", (F.col("t.score") >= 0.5).cast("int").alias("predicted"), "t.spans")
