"""Language identification: a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.batches import bounded
from recollect.session import broadcast_if_small

STEPS = 64  # bytes of one stretch; the network starts afresh at each
HIDDEN = 8
BLOCK = 2048  # stretches that run side by side
SPARE = 1.3  # times the rows of a sample that are ranked for it


@dataclass
class Network:
    """Weights. ``dirs`` holds (input table 256 x 3H, recurrent H x 3H) for each direction."""

    langs: list[str]
    dirs: list[tuple[np.ndarray, np.ndarray]]
    out: np.ndarray  # 2H x langs
    bias: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _forward(table: np.ndarray, rec: np.ndarray, bytes_: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (T, n, H) for time-major bytes (T, n). ``keep`` collects what the backward pass needs."""
    h = rec.shape[0]
    state = np.zeros((bytes_.shape[1], h), np.float32)
    states = np.empty((len(bytes_), bytes_.shape[1], h), np.float32)
    for t in range(len(bytes_)):
        x = table[bytes_[t]]
        u = state @ rec
        gates = x[:, : 2 * h] + u[:, : 2 * h]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates *= 0.5
        gates += 0.5
        r, z = gates[:, :h], gates[:, h:]
        new = np.tanh(x[:, 2 * h :] + r * u[:, 2 * h :])
        if keep is not None:
            keep.append((state, r, z, new, u[:, 2 * h :]))
        state = new + z * (state - new)
        states[t] = state
    return states


def _backward(table: np.ndarray, rec: np.ndarray, bytes_: np.ndarray, keep: list, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of input table and recurrent weights, given those of all states: through time, last step first."""
    h = rec.shape[0]
    d_table, d_rec = np.zeros_like(table), np.zeros_like(rec)
    carry = np.zeros_like(grad[0])
    for t in range(len(bytes_) - 1, -1, -1):
        state, r, z, new, un = keep[t]
        g = grad[t] + carry
        d_new = g * (1 - z) * (1 - new * new)
        d_z = g * (state - new) * z * (1 - z)
        d_r = d_new * un * r * (1 - r)
        d_u = np.concatenate([d_r, d_z, d_new * r], axis=1)
        np.add.at(d_table, bytes_[t], np.concatenate([d_r, d_z, d_new], axis=1))
        d_rec += state.T @ d_u
        carry = g * z + d_u @ rec.T
    return d_table, d_rec


def _probabilities(net: Network, forth: np.ndarray, back: np.ndarray) -> np.ndarray:
    h = forth.shape[2]
    logit = forth.reshape(-1, h) @ net.out[:h] + back.reshape(-1, h) @ net.out[h:] + net.bias
    logit -= logit.max(axis=1, keepdims=True)
    np.exp(logit, out=logit)
    logit /= logit.sum(axis=1, keepdims=True)
    return logit.reshape(forth.shape[0], forth.shape[1], -1)


def _stretches(data: bytes) -> np.ndarray:
    """Rows of STEPS bytes; the last is filled with zero bytes."""
    n = -(-len(data) // STEPS)
    return np.frombuffer(data.ljust(n * STEPS, b"\0"), np.uint8).reshape(n, STEPS)


def train(texts: list[str], langs: list[str], steps: int = 700, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Network:
    """Adam over random batches of stretches; the loss is the mean cross entropy of all positions."""
    names = sorted(set(langs))
    rows, marks = [], []
    for t, l in zip(texts, langs):
        s = _stretches(t.encode())
        rows.append(s)
        marks.append(np.full(len(s), names.index(l)))
    x = np.concatenate(rows) if rows else np.zeros((0, STEPS), np.uint8)
    y = np.concatenate(marks) if marks else np.zeros(0, int)
    rng = np.random.default_rng(seed)
    k, h = len(names), HIDDEN
    net = Network(
        names,
        [(rng.normal(0, 0.3, (256, 3 * h)).astype(np.float32), rng.normal(0, 0.3, (h, 3 * h)).astype(np.float32)) for _ in range(2)],
        rng.normal(0, 0.3, (2 * h, k)).astype(np.float32), np.zeros(k, np.float32),
    )
    if k < 2:
        return net
    by_lang = [np.flatnonzero(y == c) for c in range(k)]
    params = [*net.dirs[0], *net.dirs[1], net.out, net.bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(r, batch // k + 1) for r in by_lang])
        forth_in = np.ascontiguousarray(x[pick].T)
        back_in = np.ascontiguousarray(forth_in[::-1])
        keeps: list[list] = [[], []]
        forth = _forward(*net.dirs[0], forth_in, keeps[0])
        back = _forward(*net.dirs[1], back_in, keeps[1])[::-1]
        p = _probabilities(net, forth, back)
        weight = (forth_in > 0).astype(np.float32)
        p[:, np.arange(len(pick)), y[pick]] -= 1
        p *= (weight / weight.sum())[:, :, None]
        flat = p.reshape(-1, k)
        d_out = np.concatenate([forth.reshape(-1, h).T @ flat, back.reshape(-1, h).T @ flat])
        d_f, d_b = p @ net.out[:h].T, (p @ net.out[h:].T)[::-1]
        grads = [*_backward(*net.dirs[0], forth_in, keeps[0], d_f), *_backward(*net.dirs[1], back_in, keeps[1], d_b), d_out, flat.sum(axis=0)]
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        lr = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        for q, g, m, v in zip(params, grads, first, second):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def predict(net: Network, texts: list[str]) -> np.ndarray:
    """Mean probabilities (texts, langs) over all byte positions of each whole text."""
    total = np.zeros((len(texts), max(1, len(net.langs))))
    if not net.langs:
        return total
    rows: list[np.ndarray] = []
    owner: list[np.ndarray] = []
    held = 0

    def run() -> None:
        nonlocal held
        if not held:
            return
        x, who = np.concatenate(rows), np.concatenate(owner)
        rows.clear(), owner.clear()
        held = 0
        for a in range(0, len(x), BLOCK):
            part = np.ascontiguousarray(x[a : a + BLOCK].T)
            forth = _forward(*net.dirs[0], part)
            back = _forward(*net.dirs[1], part[::-1])[::-1]
            p = _probabilities(net, forth, back)
            p *= (part > 0)[:, :, None]
            np.add.at(total, who[a : a + BLOCK], p.sum(axis=0, dtype=np.float64))

    for k, t in enumerate(texts):
        data = t.encode()
        for a in range(0, len(data), BLOCK * STEPS):
            s = _stretches(data[a : a + BLOCK * STEPS])
            rows.append(s)
            owner.append(np.full(len(s), k))
            held += len(s)
            if held >= BLOCK:
                run()
    run()
    return total / np.maximum(total.sum(axis=1, keepdims=True), 1e-12)


def training_sample(docs: DataFrame, per_lang: int = 600, chars: int = 384, text: str = "text", lang: str = "lang", key: str = "doc_id") -> tuple[list[str], list[str]]:
    """At most ``per_lang`` labelled rows of each language, least seeded hash first, and of each row the two
    stretches of ``chars`` characters at its beginning and at a hashed place: the bound of what reaches the driver.

    The number of a language's rows tells below which hash about ``SPARE`` times as many lie;
    only these few are ranked, so a language that most rows have costs no more than another.

    Defined cases: rows without language, without text or without a letter take no part;
    rows that agree in key, length and stretches count once; ties of the hash go by the
    stretches; an empty table gives two empty lists.
    """
    able = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    h = F.xxhash64(F.lit(11), F.col(key), F.length(text))
    sizes = able.groupBy(F.col(lang).alias("_l")).agg(F.count(F.lit(1)).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(SPARE * per_lang + 100) / F.col("_n"))
    edges = sizes.select("_l", (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).alias("_edge"))
    place = F.pmod(h, F.greatest(F.length(text) - chars, F.lit(1))).cast("int") + 1
    slim = able.select(F.col(lang).alias("_l"), h.alias("_h"), F.substring(F.col(text), 1, chars).alias("_a"), F.substr(F.col(text), place, F.lit(chars)).alias("_b"))
    few = slim.join(broadcast_if_small(edges), "_l").where(F.col("_h") <= F.col("_edge")).drop("_edge").distinct()
    top = few.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_h", "_a", "_b"))).where(F.col("_r") <= per_lang)
    got = sorted((r["_l"], r["_r"], r["_a"], r["_b"]) for r in top.collect())
    texts, langs = [], []
    for l, _, a, b in got:
        texts += [a, b]
        langs += [l, l]
    return texts, langs


def label(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (the pooled probability of that language).

    Every byte of the text is labelled from both sides and the probabilities are averaged.
    Defined cases: null texts and texts without a letter get ``und`` and 0; so does every
    row if no language was learned; repeated rows get the same result; columns of the two
    names are replaced; an empty table gives an empty result.
    """

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            p = predict(net, b.fillna("").tolist())
            best = p.argmax(axis=1) if net.langs else np.zeros(len(b), int)
            yield pd.DataFrame({"lang_pred": [net.langs[k] if net.langs else None for k in best], "score": p[np.arange(len(p)), best]})

    able: Column = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) & F.lit(bool(net.langs))
    rest = docs.drop(*[c for c in ("lang_pred", "score", "_p") if c != text])
    return bounded(rest).withColumn("_p", run(F.col(text))).withColumns({
        "lang_pred": F.when(able, F.col("_p.lang_pred")).otherwise("und"),
        "score": F.when(able, F.least(F.col("_p.score"), F.lit(1.0))).otherwise(0.0),
    }).drop("_p")


def identify(docs: DataFrame, labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Trains on a bounded sample of ``labelled`` and labels every row of ``docs``."""
    return label(docs, train(*training_sample(labelled, text=text, lang=lang, key=key)), text)
