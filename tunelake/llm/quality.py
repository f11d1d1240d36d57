"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages (runs of ``PASSAGE`` words). Each passage becomes a vector of
measures of its form (character classes, word lengths, repetition, punctuation). An encoder maps it
to a hidden vector, a gated attention gives it a weight among the passages of its document, and the
weighted sum of the hidden vectors is classified. Only documents carry labels; which passages
matter is learned from them.

The model is trained on the driver, on a bounded sample of labelled documents (``sample``); what
reaches the driver are passage measures of that sample only. Scoring reads whole texts in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import filled, small_batches

PASSAGE = 128
#: Documents below this score are rejected.
CUT = 0.3
#: Bytes of text that are measured together in a task, besides one text that is larger alone.
CHUNK = 1 << 20

_SPACE = b" \t\n\x0b\x0c\r"
_CLASSES = (
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",;:",
    b"!?", b"|", b"#$%&*@^~=+<>", b"'\"()-_/", b"[]{}\\`", b"\n", bytes(range(128, 256)),
)
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _c in enumerate(_CLASSES):
    _CLASS[list(_c)] = _i
_IS_SPACE = np.isin(np.arange(256), list(_SPACE))
_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)
_VALUE[list(_SPACE)] = 0
_BASE = 0x9E3779B97F4A7C15
WIDTH = len(_CLASSES) + 1 + 13


@lru_cache(maxsize=1)
def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.full(n, base, np.uint64))
                     for base in (_BASE, pow(_BASE, -1, 2**64)))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse (modulo 2**64), n at least."""
    return _power_table(max(2 * CHUNK, n))


def measures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A row of measures per passage, and the number of passages of each text (1 at least: a text
    without words is one passage of zeros)."""
    parts = [t.encode(errors="surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    text_end = np.cumsum([len(p) + 1 for p in parts])
    space = _IS_SPACE[data]
    word_byte = ~space
    begin = np.flatnonzero(word_byte & np.r_[True, space[:-1]]) if len(data) else np.zeros(0, int)
    end = np.flatnonzero(word_byte & np.r_[space[1:], True]) + 1 if len(data) else begin
    of_text = np.searchsorted(text_end, begin, "right")
    n_words = np.bincount(of_text, minlength=len(texts))
    first_word = np.cumsum(n_words) - n_words
    within = np.arange(len(begin)) - first_word[of_text]
    bags = np.maximum(1, -(-n_words // PASSAGE))
    first_bag = np.cumsum(bags) - bags
    out = np.zeros((int(bags.sum()), WIDTH), np.float32)
    if not len(begin):
        return out, bags
    passage = first_bag[of_text] + within // PASSAGE
    opens = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    ids, words = passage[opens], np.diff(np.r_[opens, len(passage)])

    # Bytes by class, from a passage's first word to the next passage or the end of its text.
    from_byte = begin[opens]
    to_byte = np.minimum(np.r_[from_byte[1:], len(data)], text_end[of_text[opens]])
    kinds = _CLASS[data]
    n_bytes = np.maximum(1, to_byte - from_byte)
    # One count for all: cell = passage and class; what lies between passages goes to a last row.
    n_kinds = len(_CLASSES) + 1
    runs = np.diff(np.r_[0, np.stack([from_byte, to_byte], 1).ravel(), len(data)])
    row = np.full(len(runs), len(ids) * n_kinds, np.int64)
    row[1::2] = np.arange(len(ids)) * n_kinds
    cells = np.bincount(np.repeat(row, runs) + kinds, minlength=(len(ids) + 1) * n_kinds)
    out[ids, :n_kinds] = cells.reshape(-1, n_kinds)[:-1] / n_bytes[:, None]

    length = end - begin
    # A word's hash: its bytes times powers that count from the word's begin.
    powers, inverses = _powers(len(data))
    with np.errstate(over="ignore"):
        word = np.add.reduceat(_VALUE[data] * powers[:len(data)], begin) * inverses[begin]
    key = (word ^ (word >> np.uint64(32))) & np.uint64((1 << 40) - 1)
    in_passage = (np.cumsum(np.r_[0, passage[1:] != passage[:-1]]).astype(np.uint64)
                  << np.uint64(40)) | key
    distinct = np.unique(in_passage)
    n_distinct = np.bincount((distinct >> np.uint64(40)).astype(np.int64), minlength=len(ids))
    same = np.r_[False, (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])]
    first, last = kinds[begin], kinds[end - 1]

    def mean(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.astype(np.float64), opens) / words

    spread = np.sqrt(np.maximum(0, mean(length.astype(np.float64) ** 2) - mean(length) ** 2))
    columns = (
        mean(length) / 10, spread / 10, mean(length <= 2), mean(length >= 10), mean(length == 1),
        n_distinct / words, mean(same), mean(first == 1), mean((last >= 3) & (last <= 9)),
        mean(last == 3), mean((first >= 3) & (first <= 9)), np.log1p(words) / 5,
        np.log1p(n_words[of_text[opens]]) / 10,
    )
    for i, column in enumerate(columns):
        out[ids, len(_CLASSES) + 1 + i] = column
    return out, bags


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """Weights; ``mean`` and ``scale`` standardise the measures."""

    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray
    gate_v: np.ndarray
    gate_u: np.ndarray
    attend: np.ndarray
    classify: np.ndarray

    def forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        x = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        h = np.tanh(x @ self.encode)
        h1 = np.c_[h, np.ones(len(h))]
        v, u = np.tanh(h1 @ self.gate_v), _sigmoid(h1 @ self.gate_u)
        starts = np.cumsum(bags) - bags
        logit = (v * u) @ self.attend
        logit -= np.repeat(np.maximum.reduceat(logit, starts), bags)
        weight = np.exp(logit)
        weight /= np.repeat(np.add.reduceat(weight, starts), bags)
        pooled = np.add.reduceat(h * weight[:, None], starts)
        z = pooled @ self.classify[:-1] + self.classify[-1]
        return {"x": x, "h": h, "h1": h1, "v": v, "u": u, "a": weight, "m": pooled,
                "p": _sigmoid(z), "starts": starts}

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self.forward(x, bags)["p"]


def trained(x: np.ndarray, bags: np.ndarray, y: np.ndarray, hidden: int = 16, gate: int = 8,
            steps: int = 400, rate: float = 0.02, decay: float = 1e-4, batch: int = 512,
            seed: int = 5) -> Model:
    """Adam on the mean cross-entropy of the documents' labels. With no documents, or only one
    label, the model is constant: the labels' mean, or a half."""
    rng = np.random.default_rng(seed)
    width = WIDTH + 1
    mean = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = np.maximum(x.std(0), 0.02) if len(x) else np.ones(WIDTH)
    names = ("encode", "gate_v", "gate_u", "attend", "classify")
    shapes = ((width, hidden), (hidden + 1, gate), (hidden + 1, gate), (gate,), (hidden + 1,))
    model = Model(mean, scale, *(rng.normal(0, 1 / np.sqrt(s[0]), s) for s in shapes))
    if not len(y) or y.min() == y.max():
        model.classify[:] = 0
        rate_one = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        model.classify[-1] = np.log(rate_one / (1 - rate_one))
        return model
    first = np.cumsum(bags) - bags
    m1 = {n: np.zeros(s) for n, s in zip(names, shapes)}
    m2 = {n: np.zeros(s) for n, s in zip(names, shapes)}
    for step in range(1, steps + 1):
        docs = rng.integers(0, len(y), min(batch, len(y)))
        n = bags[docs]
        at = np.repeat(first[docs] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        f = model.forward(x[at], n)
        dz = (f["p"] - y[docs]) / len(docs)
        grad = {"classify": np.r_[f["m"].T @ dz, dz.sum()]}
        dm = np.repeat(dz[:, None] * model.classify[:-1], n, axis=0)
        da = (dm * f["h"]).sum(1)
        inner = np.repeat(np.add.reduceat(f["a"] * da, f["starts"]), n)
        ds = f["a"] * (da - inner)
        grad["attend"] = (f["v"] * f["u"]).T @ ds
        dv = ds[:, None] * model.attend * f["u"] * (1 - f["v"] ** 2)
        du = ds[:, None] * model.attend * f["v"] * f["u"] * (1 - f["u"])
        grad["gate_v"], grad["gate_u"] = f["h1"].T @ dv, f["h1"].T @ du
        dh = dm * f["a"][:, None] + dv @ model.gate_v[:-1].T + du @ model.gate_u[:-1].T
        grad["encode"] = f["x"].T @ (dh * (1 - f["h"] ** 2))
        now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
        for name in names:
            value = getattr(model, name)
            g = grad[name] + decay * value
            m1[name] = 0.9 * m1[name] + 0.1 * g
            m2[name] = 0.999 * m2[name] + 0.001 * g * g
            value -= now * (m1[name] / (1 - 0.9**step)) / (
                np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(row_id: str = "doc_id") -> Column:
    """Rows that no label may be learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col(row_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows whose texts (the last column) hold about CHUNK bytes together."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        sizes = pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK, "right")))
            yield batch.slice(at, end - at), texts.slice(at, end - at).to_pylist()
            at = end


def fitted(docs: DataFrame, labels: DataFrame, text: str = "text", row_id: str = "doc_id",
           label: str = "quality", sample: int = 6000) -> Model:
    """A model of the labels, from at most ``sample`` labelled documents that aren't held out (those
    first by a hash of the id). Null labels and ids are left out; of several labels of a document
    the mean counts, and of repeated documents the label counts for each."""
    chosen = labels.where(
        F.col(row_id).isNotNull() & F.col(label).isNotNull() & ~held_out(row_id)
    ).groupBy(F.col(row_id).cast("long").alias("__doc")).agg(
        F.avg(F.col(label).cast("double")).alias("__y")
    ).orderBy(F.xxhash64("__doc"), "__doc").limit(sample)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, texts in _groups(batches):
            x, bags = measures(texts)
            ends = np.cumsum(bags)
            yield pa.RecordBatch.from_arrays([
                group.column(0), group.column(1),
                pa.array([x[e - n:e].astype(np.float32).tobytes() for e, n in zip(ends, bags)]),
            ], ["__doc", "__y", "__x"])

    small_batches(docs.sparkSession)
    # At most ``sample`` lines are sent to the tasks, so that the documents needn't move.
    rows = docs.select(F.col(row_id).cast("long").alias("__doc"), filled(text).alias("__text")
                       ).join(F.broadcast(chosen), "__doc").select("__doc", "__y", "__text")
    found = rows.mapInArrow(measure, "__doc long, __y double, __x binary").toPandas()
    found = found.sort_values(["__doc", "__x"], kind="stable")
    bags = [np.frombuffer(b, np.float32).reshape(-1, WIDTH) for b in found["__x"]]
    x = np.concatenate(bags).astype(np.float64) if bags else np.zeros((0, WIDTH))
    return trained(x, np.array([len(b) for b in bags], np.int64),
                   found["__y"].to_numpy(np.float64))


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the column ``score`` (0 to 1; higher: label 1 likelier).

    Only the text counts. Null and empty texts are one passage of zeros and are scored too. Repeated
    rows are scored each, alike. An empty table gives an empty result. Texts are read whole. A
    column of ``docs`` of that name is replaced.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def measured(texts: pd.Series) -> pd.Series:
        out = []
        for _, group in _groups([pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.large_string())], ["text"])]):
            x, bags = measures(group)
            out.append(model.score(x.astype(np.float64), bags))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(score, measured(filled(text)))
