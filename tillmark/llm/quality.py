"""Quality by attention-based multiple-instance learning.

Every passage of a document is encoded; a gated attention, learned from document
labels alone, weighs the passages, and a logistic unit scores the weighted
representation.  Encodings describe the shape of a passage (kinds of bytes that
follow each other, repetition, word lengths), so they need no vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tillmark.llm.kernels import NOT_SPACE, Texts, pieces, words
from tillmark.llm.labelled import LabelSample, label_sample

FOLDS, HELD = 5, 0
PASSAGE_WORDS = 48
# labelled documents the model is fitted on, at most
MAX_ROWS = 6000
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
EPOCHS, BATCH, RATE = 60, 256, 0.01
_LAGS = (1, 2, 3, 4)


def byte_kinds() -> np.ndarray:
    """Lower, upper, digit, blank, newline, sentence mark, other symbol, not ASCII."""
    kinds = np.full(256, 6, dtype=np.int64)
    kinds[97:123], kinds[65:91], kinds[48:58] = 0, 1, 2
    kinds[[9, 11, 12, 13, 32]], kinds[10] = 3, 4
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = 5
    kinds[128:] = 7
    return kinds


KINDS = byte_kinds()
WIDTH = 64 + 3 + len(_LAGS) + 1


def encode(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Encoding of every passage, and the passages of row r as ``offsets[r]:offsets[r + 1]``.

    A passage is ``PASSAGE_WORDS`` words and what follows them; a text without
    words is one passage.
    """
    found = words(texts, NOT_SPACE)
    counts = np.diff(found.offsets)
    amount = np.maximum(1, -(-counts // PASSAGE_WORDS))
    offsets = np.concatenate([[0], np.cumsum(amount)])
    total = int(offsets[-1])
    rows = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(rows)) - found.offsets[:-1][rows]
    passage = offsets[:-1][rows] + nth // PASSAGE_WORDS

    # a passage's bytes: from its first word, or the row's start, to the next one
    begin = np.full(total, -1, dtype=np.int64)
    begin[offsets[:-1]] = texts.offsets[:-1]
    later = np.flatnonzero((nth % PASSAGE_WORDS == 0) & (nth > 0))
    begin[passage[later]] = found.starts[later]
    size = np.diff(np.append(begin, texts.offsets[-1]))
    of_byte = np.repeat(np.arange(total), size)
    kinds = KINDS[texts.data]
    pair = of_byte[:-1] * 64 + kinds[:-1] * 8 + kinds[1:]
    same = of_byte[:-1] == of_byte[1:]
    shape = np.bincount(pair[same], minlength=total * 64).reshape(total, 64)

    in_passage = np.maximum(np.bincount(passage, minlength=total), 1)
    length = found.ends - found.starts
    mean = np.bincount(passage, weights=length, minlength=total) / in_passage
    spread = np.bincount(passage, weights=length.astype(float) ** 2, minlength=total) / in_passage - mean**2
    order = np.lexsort((found.hashes, passage))
    h, p = found.hashes[order], passage[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (p[1:] != p[:-1])
    distinct = np.bincount(p[new], minlength=total) / in_passage
    repeats = []
    for lag in _LAGS:
        equal = (found.hashes[lag:] == found.hashes[:-lag]) & (rows[lag:] == rows[:-lag])
        repeats.append(np.bincount(passage[lag:][equal], minlength=total) / in_passage)
    out = np.column_stack(
        [
            shape / np.maximum(size, 1)[:, None],
            np.minimum(mean, 50) / 10,
            np.sqrt(np.maximum(spread, 0)).clip(0, 50) / 10,
            distinct,
            *repeats,
            np.log1p(np.bincount(passage, minlength=total)),
        ]
    )
    return out.astype(np.float32), offsets


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    parts: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """All quantities of a pass; ``x`` is standardised."""
        w = self.parts
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        left, right = np.tanh(h @ w["left"]), 1 / (1 + np.exp(-(h @ w["right"])))
        energy = (left * right) @ w["attend"]
        starts = offsets[:-1]
        of = np.repeat(np.arange(len(starts)), np.diff(offsets))
        weight = np.exp(energy - np.maximum.reduceat(energy, starts)[of])
        weight = weight / np.add.reduceat(weight, starts)[of]
        bag = np.add.reduceat(h * weight[:, None], starts, axis=0)
        p = 1 / (1 + np.exp(-np.clip(bag @ w["out"] + w["out_bias"], -30, 30)))
        return {"h": h, "left": left, "right": right, "of": of, "weight": weight, "bag": bag, "p": p}

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).clip(-8, 8)

    def score(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return self.forward(self.standardised(x), offsets)["p"]

    def gradients(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.parts, self.forward(x, offsets)
        d_logit = (f["p"] - y) / len(y)
        d_bag = d_logit[:, None] * w["out"]
        spread = d_bag[f["of"]]
        d_weight = (spread * f["h"]).sum(axis=1)
        inner = np.add.reduceat(d_weight * f["weight"], offsets[:-1])[f["of"]]
        d_energy = f["weight"] * (d_weight - inner)
        gated = d_energy[:, None] * w["attend"]
        d_left = gated * f["right"] * (1 - f["left"] ** 2)
        d_right = gated * f["left"] * f["right"] * (1 - f["right"])
        d_h = spread * f["weight"][:, None] + d_left @ w["left"].T + d_right @ w["right"].T
        d_in = d_h * (1 - f["h"] ** 2)
        return {
            "encode": x.T @ d_in,
            "encode_bias": d_in.sum(axis=0),
            "left": f["h"].T @ d_left,
            "right": f["h"].T @ d_right,
            "attend": (f["left"] * f["right"]).T @ d_energy,
            "out": f["bag"].T @ d_logit,
            "out_bias": d_logit.sum(),
        }


def train(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, seed: int = 1) -> QualityModel:
    """Fit by Adam on shuffled batches of documents; deterministic."""
    rng = np.random.default_rng(seed)

    def start(*shape: int) -> np.ndarray:
        return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

    mean = x.mean(axis=0) if len(x) else np.zeros(WIDTH)
    scale = np.maximum(x.std(axis=0) if len(x) else np.ones(WIDTH), 1e-4)
    rate = (y.sum() + 1) / (len(y) + 2)
    model = QualityModel(
        mean,
        scale,
        {
            "encode": start(WIDTH, HIDDEN),
            "encode_bias": np.zeros(HIDDEN),
            "left": start(HIDDEN, GATE),
            "right": start(HIDDEN, GATE),
            "attend": np.zeros(GATE) + 0.1,
            "out": np.zeros(HIDDEN),
            "out_bias": np.array(np.log(rate / (1 - rate))),
        },
    )
    x = model.standardised(x)
    first = {k: np.zeros_like(v) for k, v in model.parts.items()}
    second = {k: np.zeros_like(v) for k, v in model.parts.items()}
    sizes, step = np.diff(offsets), 0
    for epoch in range(EPOCHS if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            docs = order[at : at + BATCH]
            cut = np.concatenate([[0], np.cumsum(sizes[docs])])
            inside = np.arange(cut[-1]) - np.repeat(cut[:-1], sizes[docs])
            grads = model.gradients(x[np.repeat(offsets[docs], sizes[docs]) + inside], cut, y[docs])
            step += 1
            speed = RATE * (1 - epoch / EPOCHS)
            for k, g in grads.items():
                g = g + 1e-4 * model.parts[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                size = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
                model.parts[k] = model.parts[k] - speed * size
    return model


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Learn from ``labels.quality`` of at most about ``max_rows`` rows that are not held out.

    The sample is chosen by hash and encoded where the texts lie; its passages are
    all that reaches the driver.
    """
    sample: LabelSample = label_sample(labels, "quality", FOLDS, HELD, max_rows)
    shared = docs.sparkSession.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = shared.value(batch.column(0))
            chosen = batch.filter(pa.array(label >= 0))
            label = label[label >= 0]
            for texts in pieces(chosen.column(1)):
                x, offsets = encode(texts)
                of = np.repeat(np.arange(len(texts)), np.diff(offsets)) + texts.first
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), WIDTH).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays(
                    [
                        chosen.column(0).cast(pa.int64()).take(pa.array(of)),
                        pa.array(np.arange(len(x)) - offsets[of - texts.first]),
                        values,
                        pa.array(label[of]),
                    ],
                    ["doc_id", "nth", "x", "label"],
                )

    schema = "doc_id long, nth long, x array<float>, label long"
    table = docs.select("doc_id", "text").mapInArrow(run, schema).toArrow()
    ids, nth = table.column("doc_id").to_numpy(), table.column("nth").to_numpy()
    order = np.lexsort((nth, ids))
    x = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, WIDTH).astype(float)[order]
    starts = np.flatnonzero(nth[order] == 0) if len(ids) else np.zeros(0, dtype=np.int64)
    y = np.clip(table.column("label").to_numpy()[order][starts], 0, 1).astype(float)
    return train(x, np.append(starts, len(x)), y)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``doc_id, score`` of every row, 0 to 1, from ``text`` alone.

    A missing or empty text, or one without words, is a document of one empty
    passage.  Repeated rows each give a row; ids may be missing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in pieces(batch.column(1)):
                p = shared.value.score(*encode(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(texts.first, len(texts)), pa.array(p)], ["doc_id", "score"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
