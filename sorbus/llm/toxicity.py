"""Toxic spans by a linear-chain conditional random field (operator 2).

Document labels become token labels: within documents marked toxic, tokens with a feature (the word, or how it begins) that
is far commoner there than in the others. The field (a weight per feature, a share for rare words, transitions, starts) is
trained on them by gradients from forward-backward marginals, a batch of documents at a time; a logistic curve turns a
document's summed and largest marginals into its score.

Null, empty or wordless text gets the score of no toxic token and no spans. Training takes at most `max_rows` labelled
rows and `max_bytes` of whole texts, the least by a hash of the id; rows without label are not used. Of repeated labels
of an id the largest holds; repeated rows of an id are each learnt from. Without both labels every score is 0. The model
holds at most the features of that sample. Extra columns pass through except those named like the new ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import held_out, map_arrow, prepare, sample_rows, table, texts_of

TOKEN = re.compile(r"\w+")
BEGINS = (4, 5)  # lengths, in code points, of the beginnings that are features of a word
TELLING = 20  # times commoner in documents marked toxic than in the others
BATCH = 60_000  # tokens whose messages are held at once
RARE = "\0"  # the feature of words that the sample has once at most


def features(word: str) -> list[str]:
    """What a token is judged by: its word in lower case, and the beginnings of longer words."""
    w = word.lower()
    return [w, *(f"{w[:n]}*" for n in BEGINS if len(w) > n)]


def forward(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Row vectors first @ m[0] @ ... @ m[t], each scaled to sum 1, by blocks whose products are scanned in turn."""
    n, size = len(m), 64
    if n <= size:
        out, v = np.empty((n, 2)), first
        for t in range(n):
            v = v @ m[t]
            out[t] = v = v / v.sum()
        return out
    rows = -(-n // size)
    grid = np.broadcast_to(np.eye(2), (rows * size, 2, 2)).copy()
    grid[:n] = m
    grid = grid.reshape(rows, size, 2, 2)
    prod = grid[:, 0].copy()
    for j in range(1, size):
        prod = prod @ grid[:, j]
        prod /= prod.sum((1, 2), keepdims=True)
    v = np.concatenate([first[None], forward(prod[:-1], first)])
    out = np.empty((rows, size, 2))
    for j in range(size):
        v = (v[:, None, :] @ grid[:, j])[:, 0]
        v /= v.sum(1, keepdims=True)
        out[:, j] = v
    return out.reshape(-1, 2)[:n]


def marginals(score: np.ndarray, begins: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """P(toxic) per token of documents laid end to end; also the matrices and both messages."""
    e = np.exp(np.clip(score, -30, 30))
    m = np.repeat(np.exp(model["moves"])[None], len(e), 0)
    m[begins] = np.exp(model["start"])
    m[:, :, 1] *= e[:, None]
    m /= m.sum((1, 2), keepdims=True)
    half = np.array([0.5, 0.5])
    a = forward(m, half)
    b = np.full((len(e), 2), 0.5)
    if len(e) > 1:
        b[:-1] = forward(np.ascontiguousarray(m[1:][::-1].transpose(0, 2, 1)), half)[::-1]
    p = a * b
    return p[:, 1] / p.sum(1), m, a, b


def batches(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of documents of BATCH tokens each; a longer document is a range of its own."""
    lo = 0
    for hi in range(1, len(at)):
        if hi == len(at) - 1 or at[hi + 1] - at[lo] > BATCH:
            yield lo, hi
            lo = hi


def summary(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the summed marginals, and the largest marginal."""
    out = np.zeros((len(at) - 1, 3))
    out[:, 0] = 1
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full, 1] = np.log1p(np.add.reduceat(p, at[full]))
        out[full, 2] = np.maximum.reduceat(p, at[full])
    return out


def share(x: np.ndarray, curve: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))


class Emissions(dict):
    """word, as it stands -> its weight under a model, kept up to a bound."""

    LIMIT = 200_000

    def __init__(self, weight: dict[str, float]):
        self.weight = weight

    def __missing__(self, word: str) -> float:
        known = [self.weight[f] for f in features(word) if f in self.weight]
        if len(self) >= self.LIMIT:
            self.clear()
        self[word] = total = sum(known) if known else self.weight[RARE]
        return total


def held_emissions(model: dict) -> Emissions:
    if "held" not in model:
        model["held"] = Emissions(model["weight"])
    return model["held"]


def judged(texts: list[str], model: dict) -> tuple[np.ndarray, np.ndarray]:
    """P(toxic) of every token of the texts, end to end, and where each text's begin."""
    get = held_emissions(model).__getitem__
    per_text = [np.fromiter(map(get, TOKEN.findall(t)), float) for t in texts]
    at = np.cumsum([0] + [len(x) for x in per_text])
    p = np.empty(at[-1])
    for lo, hi in batches(at):
        if at[hi] > at[lo]:
            score = np.concatenate(per_text[lo:hi])
            begins = at[lo:hi][np.diff(at[lo : hi + 1]) > 0] - at[lo]
            p[at[lo] : at[hi]] = marginals(score, begins, model)[0]
    return p, at


def train(rows: list[tuple[str, int]], steps: int = 110, rate: float = 0.15) -> dict | None:
    """A model of (text, label) rows, from `steps` batches of documents; messages are held for one batch at a time."""
    y = np.array([r[1] for r in rows])
    if len(set(y.tolist())) < 2:
        return None
    code: dict[str, int] = {}
    docs = [np.fromiter((code.setdefault(w, len(code)) for w in map(str.lower, TOKEN.findall(t))), np.int32) for t, _ in rows]
    at = np.cumsum([0] + [len(d) for d in docs])
    if not at[-1]:
        return None
    name: dict[str, int] = {}
    of_word = [[name.setdefault(f, len(name)) for f in features(w)] for w in code]  # features of each distinct word
    edge = np.cumsum([0] + [len(x) for x in of_word])
    flat = np.fromiter((f for x in of_word for f in x), np.int64)
    bad, good = np.zeros(len(name)), np.zeros(len(name))
    for d, label in zip(docs, y, strict=True):
        kinds = np.unique(d)
        found = np.unique(np.concatenate([flat[edge[w] : edge[w + 1]] for w in kinds.tolist()])) if len(kinds) else kinds
        (bad if label else good)[found] += 1
    odds = np.log((bad + 0.5) / (y.sum() + 1)) - np.log((good + 0.5) / ((1 - y).sum() + 1))
    telling = (odds > np.log(TELLING)) & (bad >= 3)
    hot = np.logical_or.reduceat(telling[flat], edge[:-1])  # per word: has it a telling feature?
    # Features of one document have no weight; a word without any other shares RARE's, in the last place.
    own = np.where(bad + good >= 2, np.cumsum(bad + good >= 2) - 1, -1)
    names = [f for f, k in name.items() if own[k] >= 0]
    slots = np.full((len(of_word), 1 + len(BEGINS)), len(names) + 1)  # the place beyond the last weighs nothing
    for w, fs in enumerate(of_word):
        kept = [own[f] for f in fs if own[f] >= 0] or [len(names)]
        slots[w, : len(kept)] = kept
    n = len(names) + 1
    theta = np.concatenate([np.full(n, -0.5), np.zeros(8)])  # weights, moves, starts
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    model = {"moves": np.zeros((2, 2)), "start": np.zeros((2, 2))}
    weigh = lambda: np.append(theta[:n], 0.0)[slots].sum(1)  # noqa: E731  of each distinct word
    ranges = list(batches(at))
    rng = np.random.default_rng(11)
    order: list[int] = []
    for step in range(1, steps + 1):
        order = order or rng.permutation(len(ranges)).tolist()
        lo, hi = ranges[order.pop()]
        words = np.concatenate(docs[lo:hi])
        if not len(words):
            continue
        begins = at[lo:hi][np.diff(at[lo : hi + 1]) > 0] - at[lo]
        label = hot[words] & np.repeat(y[lo:hi] == 1, np.diff(at[lo : hi + 1]))
        model["moves"], model["start"] = theta[n : n + 4].reshape(2, 2), theta[n + 4 :].reshape(2, 2)
        p, m, a, b = marginals(weigh()[words], begins, model)
        opens = np.zeros(len(words), bool)
        opens[begins] = True
        before = np.vstack([[0.5, 0.5], a[:-1]])
        before[begins] = 0.5  # a document's first state follows either of two equal ones
        xi = before[:, :, None] * m * b[:, None, :]
        xi /= xi.sum((1, 2), keepdims=True)
        lab = label.astype(int)
        seen = np.zeros((len(words), 2, 2))
        prev = np.append(0, lab[:-1])
        seen[np.arange(len(words)), prev, lab] = 1
        seen[opens] = 0
        seen[np.flatnonzero(opens), :, lab[opens]] = 0.5
        diff = xi - seen
        by_word = np.bincount(words, p - lab, len(of_word))
        times = np.bincount(words, minlength=len(of_word))
        g = np.bincount(slots.ravel(), np.repeat(by_word, slots.shape[1]), n + 1)[:n]
        count = np.bincount(slots.ravel(), np.repeat(times, slots.shape[1]), n + 1)[:n]
        g = np.concatenate([g / (count + 1), diff[~opens].sum(0).ravel() / len(words), diff[opens].sum(0).ravel() / len(words)]) + 1e-3 * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.99 * m2 + 0.01 * g * g
        theta = theta - rate * (1 - (step - 1) / steps) * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
    model = {"weight": dict(zip([*names, RARE], theta[:n].tolist(), strict=True)), "moves": theta[n : n + 4].reshape(2, 2), "start": theta[n + 4 :].reshape(2, 2)}
    x = []
    for lo, hi in batches(at):
        p, own_at = judged([r[0] for r in rows[lo:hi]], model)
        x.append(summary(p, own_at))
    x, curve = np.concatenate(x), np.zeros(3)
    for _ in range(30):
        q = share(x, curve)
        curve -= np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (q - y) + 0.05 * curve)
    del model["held"]
    return model | {"curve": curve}


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 12 << 20) -> dict | None:
    """A model from labelled documents outside the held-out fold: at most max_rows of them, with max_bytes of text."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = sample_rows(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(~held_out()).join(marked, "doc_id"), "doc_id", "text", max_rows, max_bytes)
    return train([(r.text, int(r.toxic > 0)) for r in rows])


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with `score` and `spans`: offsets [begin, end) in code points of the tokens that are likelier toxic."""
    docs = docs.drop("score", "spans")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double, spans array<struct<begin:int,end:int>>"])
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
        for lo in range(0, batch.num_rows, 100):
            part, mod = batch.slice(lo, 100), held.value
            texts = texts_of(part.column("text"))
            scores, spans = np.zeros(len(texts)), [[] for _ in texts]
            if mod is not None:
                p, at = judged(texts, mod)
                scores = share(summary(p, at), mod["curve"])
                for k in np.unique(np.searchsorted(at, np.flatnonzero(p > 0.5), "right") - 1).tolist():
                    hot = p[at[k] : at[k + 1]] > 0.5
                    spans[k] = [{"begin": x.start(), "end": x.end()} for x, on in zip(TOKEN.finditer(texts[k]), hot, strict=True) if on]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores), pa.array(spans, kind)], names=[*part.schema.names, "score", "spans"])

    return map_arrow(docs, run, schema)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores and toxic spans of all documents, learnt from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "spans")
