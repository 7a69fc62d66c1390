"""Language identification by a bidirectional gated recurrent network over bytes (operator 10).

A text's UTF-8 bytes are cut into windows; the network labels every byte from states that run forward and backward over
its window, and the document's probabilities are the mean of the log-probabilities of all positions, turned into shares.
Trained in numpy by backpropagation through time on the whole texts of at most `max_rows` documents with at most
`max_bytes` of text, the least by a hash of the id.

Null text, or a text without a letter: `und`, score 0. No labelled row: all `und`. Whole texts count, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sorbus.llm.common import held_out, map_arrow, prepare, sample_rows, table, texts_of

HIDDEN, WINDOW, PAD = 12, 48, 256


def squash(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def windows(raw: bytes) -> np.ndarray:
    n = -(-len(raw) // WINDOW)
    x = np.full(n * WINDOW, PAD, np.int64)
    x[: len(raw)] = np.frombuffer(raw, np.uint8)
    return x.reshape(n, WINDOW)


def new_model(classes: int, rng) -> dict:
    h = HIDDEN
    m = {}
    for d in "fb":
        m["e" + d] = rng.normal(0, 0.3, (257, 3 * h))  # per byte: inputs of the update and reset gates and the candidate
        m["u" + d] = rng.normal(0, h**-0.5, (h, 2 * h))
        m["c" + d] = rng.normal(0, h**-0.5, (h, h))
    m["w"], m["b"] = rng.normal(0, 0.2, (2 * h, classes)), np.zeros(classes)
    return m


def states(x: np.ndarray, m: dict, d: str, keep: list | None = None) -> np.ndarray:
    """States after each byte, in the order in which d ('f' or 'b') reads; (bytes, rows, hidden)."""
    h = HIDDEN
    e, u, c = m["e" + d], m["u" + d], m["c" + d]
    s = np.zeros((len(x), h), e.dtype)
    out = np.empty((x.shape[1], len(x), h), e.dtype)
    for t in range(x.shape[1]) if d == "f" else range(x.shape[1] - 1, -1, -1):
        inp = e[x[:, t]]
        gate = squash(inp[:, : 2 * h] + s @ u)
        z, r = gate[:, :h], gate[:, h:]
        cand = np.tanh(inp[:, 2 * h :] + (r * s) @ c)
        if keep is not None:
            keep.append((t, s, z, r, cand))
        out[t] = s = s + z * (cand - s)
    return out


def log_shares(x: np.ndarray, m: dict) -> np.ndarray:
    """Log-probabilities of the languages per byte: (bytes, rows, classes). As `states`, but with little memory moved."""
    h, n, kind = HIDDEN, len(x), m["w"].dtype
    half = kind.type(0.5)
    xt, out = np.ascontiguousarray(x.T), None
    for k, d in enumerate("fb"):
        e, u, c = m["e" + d].copy(), m["u" + d] * half, m["c" + d]
        e[:, : 2 * h] *= half
        s, held = np.zeros((n, h), kind), np.empty((len(xt), n, h), kind)
        inp = np.empty((n, 3 * h), kind)
        for t in range(len(xt)) if d == "f" else range(len(xt) - 1, -1, -1):
            np.take(e, xt[t], 0, out=inp, mode="clip")
            gate = s @ u
            gate += inp[:, : 2 * h]
            np.tanh(gate, out=gate)
            gate += 1
            gate *= half
            cand = (gate[:, h:] * s) @ c
            cand += inp[:, 2 * h :]
            np.tanh(cand, out=cand)
            cand -= s
            cand *= gate[:, :h]
            held[t] = s = s + cand
        o = held.reshape(-1, h) @ m["w"][k * h : (k + 1) * h]
        out = o if out is None else out + o
    out += m["b"]
    out -= out.max(1, keepdims=True)
    out -= np.log(np.exp(out) @ np.ones(out.shape[1], kind))[:, None]
    return out.reshape(len(xt), n, -1)


def gradients(x: np.ndarray, y: np.ndarray, m: dict) -> dict:
    h = HIDDEN
    kept = {"f": [], "b": []}
    s = {d: states(x, m, d, kept[d]) for d in "fb"}
    o = s["f"] @ m["w"][:h] + s["b"] @ m["w"][h:] + m["b"]
    p = np.exp(o - o.max(2, keepdims=True))
    p /= p.sum(2, keepdims=True)
    p[:, np.arange(len(y)), y] -= 1
    p *= (x != PAD).T[:, :, None] / max(1, (x != PAD).sum())
    g = {"w": np.concatenate([np.einsum("tnh,tnc->hc", s[d], p) for d in "fb"]), "b": p.sum((0, 1))}
    for k, d in enumerate("fb"):
        up = p @ m["w"][k * h : (k + 1) * h].T
        u, c = m["u" + d], m["c" + d]
        ge, gu, gc, ds = np.zeros_like(m["e" + d]), np.zeros_like(u), np.zeros_like(c), 0.0
        for t, s0, z, r, cand in reversed(kept[d]):
            ds = ds + up[t]
            dc = ds * z * (1 - cand**2)
            dz = ds * (cand - s0) * z * (1 - z)
            drs = dc @ c.T
            dr = drs * s0 * r * (1 - r)
            gate = np.concatenate([dz, dr], 1)
            gu += s0.T @ gate
            gc += (r * s0).T @ dc
            np.add.at(ge, x[:, t], np.concatenate([gate, dc], 1))
            ds = ds * (1 - z) + drs * r + gate @ u.T
        g |= {"e" + d: ge, "u" + d: gu, "c" + d: gc}
    return g


def train(rows: list[tuple[str, str]], epochs: int = 3, rate: float = 0.02) -> dict | None:
    """A model of (text, language) rows, from all windows of the texts."""
    classes = sorted({lang for _, lang in rows})
    if not classes:
        return None
    rng = np.random.default_rng(7)
    xs, ys = [], []
    for text, lang in rows:
        w = windows(text.encode("utf-8", "surrogatepass"))
        xs.append(w)
        ys += [classes.index(lang)] * len(w)
    x, y = np.concatenate(xs), np.array(ys)
    m = new_model(len(classes), rng)
    m1, m2, t = {k: 0 for k in m}, {k: 0 for k in m}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 128):
            pick, t = order[lo : lo + 128], t + 1
            lr = rate * (1 - epoch / epochs)
            for k, g in gradients(x[pick], y[pick], m).items():
                m1[k], m2[k] = 0.9 * m1[k] + 0.1 * g, 0.99 * m2[k] + 0.01 * g * g
                m[k] = m[k] - lr * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.99**t)) + 1e-8)
    return {k: v.astype(np.float32) for k, v in m.items()} | {"classes": classes}


def learn(docs: DataFrame, max_rows: int = 3000, max_bytes: int = 3 << 19) -> dict | None:
    """A model from documents with a language outside the held-out fold: at most max_rows, with max_bytes of text."""
    known = docs.select("doc_id", "text", "lang").where("text is not null and lang is not null and text != '' and doc_id is not null")
    return train([(r.text, r.lang) for r in sample_rows(known.where(~held_out()), "doc_id", "text", max_rows, max_bytes)])


def predict_texts(texts: list[str | None], model: dict | None) -> tuple[list[str], list[float]]:
    ok = [k for k, t in enumerate(texts) if model is not None and t and any(map(str.isalpha, t))]
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    if not ok:
        return lang, score
    parts = [windows(texts[k].encode("utf-8", "surrogatepass")) for k in ok]
    at = np.cumsum([0] + [len(p) for p in parts])
    x = np.concatenate(parts)
    sums, counts = np.empty((len(x), len(model["classes"]))), (x != PAD).sum(1)
    for lo in range(0, len(x), 1024):  # bounded memory, whatever a text's length
        part = x[lo : lo + 1024]
        sums[lo : lo + 1024] = (log_shares(part, model) * (part != PAD).T[:, :, None]).sum(0)
    total = np.add.reduceat(sums, at[:-1]) / np.add.reduceat(counts, at[:-1])[:, None]
    p = np.exp(4 * (total - total.max(1, keepdims=True)))
    p /= p.sum(1, keepdims=True)
    for k, q in zip(ok, p, strict=True):
        best = int(q.argmax())
        lang[k], score[k] = model["classes"][best], float(q[best])
    return lang, score


def predict(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with lang_pred and lang_score; other columns pass through."""
    docs = docs.drop("lang_pred", "lang_score")
    held = prepare(docs.sparkSession).sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "lang_pred string, lang_score double"])

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            lang, score = predict_texts(part.column("text").to_pylist(), held.value)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score)], names=[*part.schema.names, "lang_pred", "lang_score"])

    return map_arrow(docs, run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = predict(docs.select("doc_id", "text"), learn(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
