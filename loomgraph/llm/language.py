"""Operator 6: language identification with a bidirectional gated recurrent network over bytes.

The network reads windows of bytes in both directions, gives every position a distribution over the
languages, and a document's log-probabilities are averaged over all its positions. It is trained on
the driver in numpy, by backpropagation through time, on a bounded sample: slices of ``SLICE`` code
points, ``PER_LANGUAGE`` per language or as many as ``SAMPLE`` gives each of the languages, one at
least. Rows and the slices' places in their texts are taken by a digest of doc_id and text. Prediction
runs in Arrow batches over every byte of every text.

Defined results: a text that is null or has no letter is ``und`` with score 0; languages are those
of the training rows, all of them; with none, all is ``und``; a long text is read window by window;
repeated rows count once in the sample and are predicted alike; on a tie the language first in order
is predicted; an empty table gives an empty result; other columns are ignored, and lang, source and
doc_id play no part in a prediction.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bounds of the training sample.
PER_LANGUAGE, SLICE, SAMPLE = 400, 256, 80_000
HIDDEN, WINDOW, ABREAST = 8, 96, 1024
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Network:
    """Weights by name. For each direction: table (byte to gate inputs), gates, candidate; then the output layer."""

    weights: dict[str, np.ndarray]
    languages: list[str]

    @classmethod
    def new(cls, languages: list[str], hidden: int = HIDDEN, seed: int = 1) -> Network:
        rng, w = np.random.default_rng(seed), {}
        for d in "fb":
            w[f"table_{d}"] = rng.normal(0, 0.3, (257, 3 * hidden))
            w[f"gates_{d}"] = rng.normal(0, hidden**-0.5, (hidden, 2 * hidden))
            w[f"new_{d}"] = rng.normal(0, hidden**-0.5, (hidden, hidden))
        w["out"] = rng.normal(0, hidden**-0.5, (2 * hidden, len(languages)))
        w["bias"] = np.zeros(len(languages))
        return cls({k: v.astype(np.float32) for k, v in w.items()}, languages)

    def states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [time, row, hidden] of bytes [time, row]; direction b runs from the end."""
        table, gates, new = (self.weights[f"{n}_{d}"] for n in ("table", "gates", "new"))
        h = new.shape[0]
        state, out = np.zeros((x.shape[1], h), np.float32), np.empty((*x.shape, h), np.float32)
        for t in range(len(x)) if d == "f" else range(len(x) - 1, -1, -1):
            given = np.take(table, x[t], axis=0)
            zr = given[:, : 2 * h] + state @ gates
            np.clip(zr, -30, 30, out=zr)
            zr = 1 / (1 + np.exp(-zr))
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(given[:, 2 * h:] + (r * state) @ new)
            if keep is not None:
                keep.append((t, state, z, r, n))
            state = n + z * (state - n)
            out[t] = state
        return out

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """[time, row, language] for bytes [time, row]."""
        h = self.weights["new_f"].shape[0]
        score = self.states(x, "f") @ self.weights["out"][:h] + self.states(x, "b") @ self.weights["out"][h:] + self.weights["bias"]
        score -= score.max(axis=-1, keepdims=True)
        return score - np.log(np.exp(score).sum(axis=-1, keepdims=True))

    def gradients(self, x: np.ndarray, y: np.ndarray, counts: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the positions that count, and its gradient, by backpropagation through time."""
        w, h = self.weights, self.weights["new_f"].shape[0]
        kept: dict[str, list] = {"f": [], "b": []}
        hidden = np.concatenate([self.states(x, d, kept[d]) for d in "fb"], axis=-1)
        score = hidden @ w["out"] + w["bias"]
        score -= score.max(axis=-1, keepdims=True)
        p = np.exp(score)
        p /= p.sum(axis=-1, keepdims=True)
        rows = np.arange(x.shape[1])
        loss = -(np.log(p[:, rows, y] + 1e-12) * counts).sum() / counts.sum()
        p[:, rows, y] -= 1
        ds = (p * (counts / counts.sum())[..., None]).astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in w.items()}
        grad["out"], grad["bias"] = np.einsum("trh,trl->hl", hidden, ds), ds.sum(axis=(0, 1))
        dh_all = ds @ w["out"].T
        for d, part in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            gates, new, back = w[f"gates_{d}"], w[f"new_{d}"], np.zeros((x.shape[1], h), np.float32)
            for t, state, z, r, n in reversed(kept[d]):
                dh = dh_all[t][:, part] + back
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (state - n) * z * (1 - z)
                inner = dn @ new.T
                dr = inner * state * r * (1 - r)
                dzr = np.concatenate([dz, dr], axis=1)
                grad[f"new_{d}"] += (r * state).T @ dn
                grad[f"gates_{d}"] += state.T @ dzr
                np.add.at(grad[f"table_{d}"], x[t], np.concatenate([dzr, dn], axis=1))
                back = dh * z + inner * r + dzr @ gates.T
        return float(loss), grad


def windows_of(raw: bytes, width: int = WINDOW) -> np.ndarray:
    """[window, byte] of a text; 256 fills the last window."""
    out = np.full(-(-len(raw) // width) * width, 256, np.int16)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    return out.reshape(-1, width)


def trained(texts: list[str], languages: list[str], steps: int = 350, rows: int = 192, seed: int = 1) -> Network:
    """A network fitted with Adam to texts and their languages; the result depends on the arguments only."""
    names = sorted(set(languages))
    net, rng = Network.new(names, seed=seed), np.random.default_rng(seed)
    cut = [(w, names.index(lang)) for text, lang in zip(texts, languages) for w in windows_of(text.encode(), 64)]
    by_language = [[w for w, k in cut if k == i] for i in range(len(names))]
    m, v = ({k: np.zeros_like(x) for k, x in net.weights.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(names), rows)
        x = np.stack([by_language[k][rng.integers(len(by_language[k]))] for k in y])
        x = x if step % 2 else np.where(np.arange(x.shape[1]) < rng.integers(6, 64, (rows, 1)), x, 256)  # short texts, too
        x = x.T
        _, grad = net.gradients(x, y, (x < 256).astype(np.float32))
        rate = 0.02 * (1 - step / (steps + 1)) + 1e-4
        for k, g in grad.items():
            g = np.clip(g, -1, 1)
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            net.weights[k] = (net.weights[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def pooled(net: Network, texts: list[str], abreast: int = ABREAST) -> np.ndarray:
    """[text, language] probabilities, from the mean log-probability over all positions of each text."""
    total = np.zeros((len(texts), len(net.languages)))
    count = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owner: list[np.ndarray] = []

    def run() -> None:
        x, of = np.concatenate(held).T, np.concatenate(owner)
        used = (x < 256).astype(np.float32)
        score = np.einsum("trl,tr->rl", net.log_probabilities(x), used)
        np.add.at(total, of, score)
        np.add.at(count, of, used.sum(axis=0))

    size = 0
    for i, text in enumerate(texts):
        windows = windows_of(text.encode())
        for a in range(0, len(windows), abreast):
            piece = windows[a: a + abreast]
            held.append(piece)
            owner.append(np.full(len(piece), i))
            size += len(piece)
            if size >= abreast:
                run()
                held, owner, size = [], [], 0
    if size:
        run()
    # a document's evidence saturates: as many positions as one window count in full
    mean = total / np.maximum(count, 1)[:, None] * np.minimum(count, WINDOW)[:, None] ** 0.5
    mean -= mean.max(axis=1, keepdims=True)
    p = np.exp(mean)
    return p / p.sum(axis=1, keepdims=True)


def predicting(net: Network | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                known = [i for i, t in enumerate(texts) if LETTER.search(t)] if net else []
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if known:
                    p = pooled(net, [texts[i] for i in known])
                    for i, q in zip(known, p):
                        lang[i], score[i] = net.languages[int(q.argmax())], float(q.max())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return run


def sample(docs: DataFrame, trainable: Column, per_language: int = PER_LANGUAGE) -> list[tuple[str, str]]:
    """(text slice, lang), at most ``per_language`` a language: those of the least digests of doc_id and text.

    Only digests below a share of their range, set by the language's count of them so that twice as many
    rows as needed pass, are ranked; so no task meets more of a frequent language than of a rare one.
    """
    rows = docs.where(trainable & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    digest = F.xxhash64("doc_id", "text")
    start = F.pmod(F.xxhash64("text"), F.greatest(F.lit(1), F.char_length("text") - SLICE + 1)).cast("int") + 1
    rows = rows.select("lang", digest.alias("digest"), F.substr("text", start, F.lit(SLICE)).alias("slice"))
    counts = stored(rows.select("lang", "digest").distinct().groupBy("lang").agg(F.count("*").alias("n")), "languages")
    each = max(1, min(per_language, SAMPLE // max(1, counts.count())))
    share = F.col("digest") / 2.0**64 + 0.5
    few = rows.join(counts, "lang").where(share * F.col("n") < 2 * each).dropDuplicates(["lang", "digest"])
    first = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("digest", "slice"))).where(F.col("rank") <= each)
    return [(r["slice"], r["lang"]) for r in first.orderBy(F.desc("n"), "lang", "slice").select("slice", "lang").collect()]


def report(docs: DataFrame, held_out: Column | None = None) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2 if held_out is None else held_out
    fitted = sample(docs, ~held_out)
    net = trained([t for t, _ in fitted], [lang for _, lang in fitted]) if fitted else None
    found = docs.select("doc_id", "text").mapInArrow(predicting(net), "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
