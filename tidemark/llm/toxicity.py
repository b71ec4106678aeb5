"""Toxicity of a text: a bidirectional gated recurrent network with attention over windows of its words.

A word enters as the sum of two learned vectors, one of the word and one averaged over its character n-grams,
so that words never met in learning count by their spelling. Every window of a text is scored (windows overlap
by half), and the text's score is a logistic function of its highest and its mean window. All of it is numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.language import held_out
from tidemark.llm.session import hash_sample
from tidemark.llm.tokens import WordTable, bare, grams

WINDOW = 48
STRIDE = 24
WORD_BUCKETS = 1 << 15
GRAM_BUCKETS = 1 << 14
SIZES = range(3, 7)
SAMPLE_ROWS = 3000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Parameters by name, all float32; `hidden` is the width of one direction."""

    hidden: int
    p: dict[str, np.ndarray] = field(default_factory=dict)
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)

    @classmethod
    def new(cls, hidden: int = 8, width: int = 10, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        p = {"word": draw(0.1, WORD_BUCKETS, width), "gram": draw(0.3, GRAM_BUCKETS, width)}
        for side in "fb":
            p[f"in_{side}"] = draw(width**-0.5, width, 3 * hidden)
            p[f"bias_{side}"] = np.zeros(3 * hidden, np.float32)
            p[f"gates_{side}"] = draw(hidden**-0.5, hidden, 2 * hidden)
            p[f"state_{side}"] = draw(hidden**-0.5, hidden, hidden)
        p |= {"look": draw((2 * hidden) ** -0.5, 2 * hidden, 8), "ask": draw(0.5, 8), "out": draw((2 * hidden) ** -0.5, 2 * hidden)}
        return cls(hidden, p | {"end": np.zeros(1, np.float32)})


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word bucket, owner and bucket of each n-gram, number of n-grams) of distinct words."""
    cleaned = [bare(w) for w in words]
    buckets = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in cleaned), np.int64, len(words))
    owner, found = grams(cleaned, SIZES, GRAM_BUCKETS)
    return buckets, owner, found, np.maximum(1, np.bincount(owner, minlength=len(words)))


def _vectors(net: Network, inputs) -> np.ndarray:
    buckets, owner, found, counts = inputs
    spelled = np.zeros((len(buckets), net.p["gram"].shape[1]), np.float32)
    values = net.p["gram"][found]
    for k in range(spelled.shape[1]):
        spelled[:, k] = np.bincount(owner, values[:, k], len(buckets))
    return net.p["word"][buckets] + spelled / counts[:, None].astype(np.float32)


def _projected(net: Network, vectors: np.ndarray) -> np.ndarray:
    """What a word adds to the gates of both directions."""
    p = net.p
    return np.concatenate([vectors @ p["in_f"] + p["bias_f"], vectors @ p["in_b"] + p["bias_b"]], axis=1)


def windows(length: int) -> list[tuple[int, int]]:
    """All overlapping windows of a text of `length` words; the last one ends with the text."""
    if length <= WINDOW:
        return [(0, length)]
    starts = list(range(0, length - WINDOW, STRIDE))
    return [(s, s + WINDOW) for s in [*starts, length - WINDOW]]


def _run(net: Network, x: np.ndarray, valid: np.ndarray, keep: bool):
    """States of both directions over (time, batch, 6 x hidden) inputs; `valid` marks real words. With `keep`, all that learning needs."""
    p, h = net.p, net.hidden
    steps, batch = valid.shape
    states, kept = np.zeros((steps, batch, 2 * h), np.float32), {}
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        at = 0 if side == "f" else 3 * h
        state = np.zeros((batch, h), np.float32)
        for t in order:
            add = x[t, :, at : at + 3 * h]
            gates = _sigmoid(add[:, : 2 * h] + state @ p[f"gates_{side}"])
            fresh = np.tanh(add[:, 2 * h :] + (gates[:, h:] * state) @ p[f"state_{side}"])
            new = state + gates[:, :h] * (fresh - state)
            mark = valid[t][:, None]
            after = np.where(mark, new, state)
            if keep:
                kept[side, t] = (state, gates, fresh)
            state = after
            states[t, :, at // 3 : at // 3 + h] = state
    looks = np.tanh(states @ p["look"])
    asked = np.where(valid, looks @ p["ask"], -1e9)
    share = np.exp(asked - asked.max(axis=0))
    share /= share.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", share, states)
    return pooled @ p["out"] + p["end"][0], (states, looks, share, pooled, kept)


def _backward(net: Network, x, valid, made, slope: np.ndarray):
    """Gradients of all shared parameters and of the inputs, from the slope of the loss by each window's logit."""
    p, h = net.p, net.hidden
    states, looks, share, pooled, kept = made
    g = {"out": pooled.T @ slope, "end": np.array([slope.sum()], np.float32)}
    d_pooled = slope[:, None] * p["out"]
    d_states = share[..., None] * d_pooled
    d_share = np.einsum("bh,tbh->tb", d_pooled, states)
    d_asked = share * (d_share - (share * d_share).sum(axis=0))
    g["ask"] = np.einsum("tb,tba->a", d_asked, looks)
    d_looks = d_asked[..., None] * p["ask"] * (1 - looks**2)
    g["look"] = np.einsum("tbh,tba->ha", states, d_looks)
    d_states = d_states + d_looks @ p["look"].T
    d_x = np.zeros_like(x)
    steps = len(valid)
    for side, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        at = 0 if side == "f" else 3 * h
        gates_w, state_w = p[f"gates_{side}"], p[f"state_{side}"]
        g[f"gates_{side}"], g[f"state_{side}"] = np.zeros_like(gates_w), np.zeros_like(state_w)
        carry = np.zeros((x.shape[1], h), np.float32)
        for t in order:
            before, gates, fresh = kept[side, t]
            mark = valid[t][:, None]
            total = carry + d_states[t, :, at // 3 : at // 3 + h]
            d_new = np.where(mark, total, 0)
            update, reset = gates[:, :h], gates[:, h:]
            d_fresh = d_new * update * (1 - fresh**2)
            d_update = d_new * (fresh - before) * update * (1 - update)
            back = d_fresh @ state_w.T
            d_reset = back * before * reset * (1 - reset)
            g[f"state_{side}"] += (reset * before).T @ d_fresh
            both = np.concatenate([d_update, d_reset], axis=1)
            g[f"gates_{side}"] += before.T @ both
            carry = np.where(mark, d_new * (1 - update) + back * reset + both @ gates_w.T, total)
            d_x[t, :, at : at + 3 * h] = np.concatenate([both, d_fresh], axis=1)
    return g, d_x


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.n = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        self.n += 1
        for k, d in g.items():
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            fair = np.sqrt(1 - 0.99**self.n) / (1 - 0.9**self.n)
            p[k] -= np.float32(self.rate * fair) * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)


def _padded(places: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(time, window) word places and which of them are real."""
    longest = max(1, max(e - s for s, e in spans))
    starts, ends = np.array(spans).T
    at = starts[None, :] + np.arange(longest)[:, None]
    valid = at < ends
    return places[np.minimum(at, max(0, len(places) - 1))] if len(places) else np.zeros_like(at), valid


def window_logits(net: Network, projected: np.ndarray, places: np.ndarray, spans: list[tuple[int, int]], batch: int = 512) -> np.ndarray:
    """The logit of each window, a bounded number at a time."""
    out = np.empty(len(spans), np.float32)
    for at in range(0, len(spans), batch):
        words, valid = _padded(places, spans[at : at + batch])
        out[at : at + batch] = _run(net, projected[words], valid, False)[0]
    return out


def fit(texts: list[str], labels: np.ndarray, natural_share: float, rounds: int = 8, seed: int = 7) -> Network:
    """A network from labelled texts.

    A text's label is taken to hold for its most suspicious window: each round scores all windows of all texts,
    then learns from the highest and one other of each. The last fifth of the texts sets the calibration, in which
    positive texts weigh as their `natural_share` says.
    """
    net = Network.new(seed=seed)
    if not len(texts) or labels.min() == labels.max():
        net.calibration = (0.0, 0.0, 5.0 if len(texts) and labels.max() > 0 else -5.0)
        return net
    rng = np.random.default_rng(seed)
    number: dict[str, int] = {}
    spans, docs, at, places = [], [], 0, []
    for d, text in enumerate(texts):
        own = [number.setdefault(w, len(number)) for w in map(bare, text.split())]
        places.extend(own)
        own_spans = [(at + s, at + e) for s, e in windows(len(own))]
        spans.extend(own_spans)
        docs.extend([d] * len(own_spans))
        at += len(own)
    places, docs, spans = np.array(places, np.int64), np.array(docs), np.array(spans)
    inputs = word_inputs(list(number)) if number else word_inputs([""])
    order_of = np.argsort(inputs[1], kind="stable")
    gram_found = inputs[2][order_of].astype(np.int32)
    gram_from = np.searchsorted(inputs[1][order_of], np.arange(len(inputs[0]) + 1))
    buckets, gram_count = inputs[0], inputs[3]
    del inputs, order_of
    first = np.flatnonzero(np.diff(docs, prepend=-1))
    learn = rng.permutation(len(texts))
    held, learn = learn[: len(texts) // 5], np.sort(learn[len(texts) // 5 :])
    adam = _Adam(net.p, 0.01)

    def of_words(kinds: np.ndarray):
        """The inputs of some of the words."""
        sel = np.concatenate([np.arange(gram_from[w], gram_from[w + 1]) for w in kinds])
        owner = np.repeat(np.arange(len(kinds)), gram_from[kinds + 1] - gram_from[kinds])
        return buckets[kinds], owner, gram_found[sel], gram_count[kinds]

    def score_all() -> np.ndarray:
        parts = np.array_split(np.arange(len(buckets)), len(buckets) // 10_000 + 1)
        projected = np.concatenate([_projected(net, _vectors(net, of_words(k))) for k in parts if len(k)])
        return window_logits(net, projected, places, spans)

    counts = np.diff(np.append(first, len(docs)))
    for k in range(rounds):
        random = first + (rng.random(len(first)) * counts).astype(int)
        if k == 0:
            more = [first + (rng.random(len(first)) * counts).astype(int) for _ in range(3)]
            chosen = np.unique(np.concatenate([random[learn], *(m[learn] for m in more)]))
        else:
            logits = score_all()
            ranked = np.lexsort((-logits, docs))
            top = ranked[first]
            clean = learn[labels[learn] == 0]
            chosen = np.unique(np.concatenate([top[learn], random[clean]]))
        adam.rate = 0.01 if k < rounds - 2 else 0.003
        for _ in range(2):
            rng.shuffle(chosen)
            for b in range(0, len(chosen), 256):
                part = chosen[b : b + 256]
                words, valid = _padded(places, spans[part])
                kinds, where = np.unique(words, return_inverse=True)
                where = where.reshape(words.shape)
                sub = of_words(kinds)
                owner = sub[1]
                vectors = _vectors(net, sub)
                x = _projected(net, vectors)[where]
                logits, made = _run(net, x, valid, True)
                y = labels[docs[part]]
                slope = ((_sigmoid(logits) - y) / len(part)).astype(np.float32)
                g, d_x = _backward(net, x, valid, made, slope)
                flat, d_flat = where.ravel(), d_x.reshape(-1, d_x.shape[-1])
                d_kind = np.stack([np.bincount(flat, d_flat[:, c], len(kinds)) for c in range(d_flat.shape[1])], axis=1).astype(np.float32)
                half = d_kind.shape[1] // 2
                g |= {"in_f": vectors.T @ d_kind[:, :half], "in_b": vectors.T @ d_kind[:, half:]}
                g |= {"bias_f": d_kind[:, :half].sum(axis=0), "bias_b": d_kind[:, half:].sum(axis=0)}
                d_vec = d_kind[:, :half] @ net.p["in_f"].T + d_kind[:, half:] @ net.p["in_b"].T
                g["word"] = np.stack([np.bincount(sub[0], d_vec[:, c], WORD_BUCKETS) for c in range(d_vec.shape[1])], axis=1).astype(np.float32)
                g["word"] += 1e-4 * net.p["word"]
                g["gram"] = 1e-4 * net.p["gram"]
                d_gram = (d_vec / sub[3][:, None])[owner]
                g["gram"] += np.stack([np.bincount(sub[2], d_gram[:, c], GRAM_BUCKETS) for c in range(d_gram.shape[1])], axis=1).astype(np.float32)
                adam.step(net.p, g)
    logits = score_all()
    high, mean = np.maximum.reduceat(logits, first), np.add.reduceat(logits, first) / counts
    held = held if len(held) and labels[held].min() < labels[held].max() else learn
    net.calibration = _calibrate(high[held], mean[held], labels[held], natural_share)
    return net


def _calibrate(high: np.ndarray, mean: np.ndarray, labels: np.ndarray, natural_share: float) -> tuple[float, float, float]:
    """Logistic weights of (highest window, mean window, 1), by Newton steps."""
    x = np.column_stack([high, mean, np.ones_like(high)]).astype(float)
    share = labels.mean()
    weight = np.where(labels > 0, natural_share / share, (1 - natural_share) / (1 - share))
    w = np.array([0.5, 0.0, 0.0])
    for _ in range(30):
        q = _sigmoid(x @ w)
        slope = x.T @ (weight * (q - labels)) + 0.05 * w
        curve = (x * (weight * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3)
        w = w - np.linalg.solve(curve, slope)
    return tuple(float(v) for v in w)


def scorer(net: Network):
    """A Spark function text -> score; null and empty texts are scored too, as a window without words."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = WordTable(lambda words: _projected(net, _vectors(net, word_inputs(words))), limit=100_000)
        blank = np.zeros((1, 6 * net.hidden), np.float32)
        for texts in batches:
            places, spans, first, at = [], [], [], 0
            for text in texts:
                words = text.split() if text else []
                first.append(len(spans))
                spans.extend((at + s, at + e) for s, e in windows(len(words)))
                places.extend(words)
                at += len(words)
            found = table.places(places)
            logits = window_logits(net, table.rows if at else blank, found, spans)
            counts = np.diff([*first, len(spans)])
            a, b, c = net.calibration
            high, mean = np.maximum.reduceat(logits, first), np.add.reduceat(logits, first) / counts
            yield pd.Series(_sigmoid((a * high + b * mean + c).astype(float)))

    return score


def learn(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    """A network from at most `rows` labelled documents, half of them toxic if there are as many.

    `labels` (doc_id, toxic); labels of an id that disagree count as toxic, null ones not at all. The sample is by the
    hash of the id; only its rows reach the driver, as whole texts.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    counts = {0: 0, 1: 0} | dict(marks.groupBy("toxic").count().collect())
    if not sum(counts.values()):
        return fit([], np.array([]), 0.0)
    share = counts[1] / (counts[0] + counts[1])
    toxic = min(rows // 2, counts[1])
    chosen = hash_sample(marks, "toxic", {0: rows - toxic, 1: toxic}, counts)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    # Of rows that repeat an id, one counts.
    texts = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in texts.collect())
    return fit([t for _, t, _ in got], np.array([y for *_, y in got], np.float32), float(share))


def score(docs: DataFrame, labels: DataFrame, parts: int = 5, which: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of `docs`; labels only of ids that are not held out are learned from.

    Rows without an id are scored and never learned from; repeated rows give repeated results; without any label
    each text scores alike, below a half. Other columns are not read.
    """
    net = learn(docs, labels.filter(~held_out(F.col("doc_id"), parts, which)), rows)
    found = docs.select("doc_id", held_out(F.col("doc_id"), parts, which).alias("held_out"), scorer(net)(F.col("text")).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that score below a half, with all their columns."""
    parts, which = options.pop("parts", 5), options.pop("which", 0)
    net = learn(docs, labels.filter(~held_out(F.col("doc_id"), parts, which)), **options)
    return docs.filter(scorer(net)(F.col("text")) < 0.5)
