"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE bytes. A passage is encoded by how its characters
follow one another (frequencies of pairs of character classes), by its own length and word
lengths, and by how many of the words that begin in it repeat the word before or end a triple
met earlier in the document. A learned layer embeds passages; gated attention, tanh(Vh) * sigmoid(Uh), weighs them; the weighted sum
of a document is scored by a logistic unit. All weights are learned together from document
labels; no passage has a label.

The fit uses at most SAMPLE_ROWS labelled documents, and of those none with more than
SAMPLE_PASSAGES passages (both parameters of fit()). Every document is scored over all its
passages; texts are read piece by piece, so memory is bounded for long ones.

Defined cases: null and empty texts are a bag of one zero passage and get a score; without any
labelled row every score is 0.5. Rows may repeat; a null doc_id
is not held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from .labels import sample

PASSAGE = 512
SAMPLE_ROWS = 4000
SAMPLE_PASSAGES = 256
MOD, HELD_OUT = 4, 2
THRESHOLD = 0.7
_CLASSES = 8


def _byte_classes() -> np.ndarray:
    """Lower, upper, digit, blank, line end, common punctuation, other symbol, beyond ASCII."""
    out = np.full(256, 6, dtype=np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 7
    out[[32, 9]], out[[10, 13]] = 3, 4
    out[list(b".,;:'\"-?()")] = 5
    return out


CLASS = _byte_classes()
SIZE = _CLASSES * _CLASSES + 4


def passages(texts: list[bytes], hasher: C.WordHasher) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows of all passages, and the number of passages of each text."""
    counts = np.array([max(1, -(-len(t) // PASSAGE)) for t in texts])
    begin = np.cumsum(counts) - counts
    x = np.zeros((int(counts.sum()), SIZE), dtype=np.float32)
    pairs = _CLASSES * _CLASSES
    for first, words, bounds, places in hasher.many(texts, placed=True):
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            text = texts[first + k]
            if not text:
                continue
            size = int(counts[first + k])
            rows = x[begin[first + k] : begin[first + k] + size]
            for at in range(0, len(text), 64 * PASSAGE):  # whole passages at a time
                piece = CLASS[np.frombuffer(text, dtype=np.uint8, count=min(64 * PASSAGE, len(text) - at), offset=at)]
                code = piece[:-1] * _CLASSES + piece[1:] + (np.arange(len(piece) - 1) // PASSAGE) * pairs
                n = -(-len(piece) // PASSAGE)
                rows[at // PASSAGE : at // PASSAGE + n, :pairs] = np.bincount(code, minlength=n * pairs)[: n * pairs].reshape(n, pairs)
            rows[:, :pairs] /= np.maximum(rows[:, :pairs].sum(axis=1, keepdims=True), 1)
            held = np.full(size, PASSAGE)
            held[-1] = len(text) - (size - 1) * PASSAGE
            w, where = words[a:b], places[a:b] // PASSAGE
            n = np.bincount(where, minlength=size)
            rows[:, pairs] = np.log1p(held / np.maximum(n, 1))
            rows[:, pairs + 3] = held / PASSAGE
            n = np.maximum(n, 1)
            again = np.zeros(len(w))
            again[1:] = w[1:] == w[:-1]
            rows[:, pairs + 1] = np.bincount(where, weights=again, minlength=size) / n
            if len(w) >= 3:
                triple = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7)
                seen = np.ones(len(triple))
                seen[np.unique(triple, return_index=True)[1]] = 0
                rows[:, pairs + 2] = np.bincount(where[2:], weights=seen, minlength=size) / n
    return x, counts


class Bag:
    """The attention model: float arrays only, so it travels in task closures."""

    HIDDEN, GATE = 24, 12

    def __init__(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int = 250, seed: int = 5):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(seed)
        h, g = self.HIDDEN, self.GATE
        init = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        self.p = {"W": init(x.shape[1], h), "b": np.zeros(h), "V": init(h, g), "U": init(h, g), "a": init(g), "c": init(h), "d": np.zeros(1)}
        self._fit(self._scaled(x), counts, y.astype(float), epochs)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8).astype(np.float64)

    def _forward(self, x: np.ndarray, counts: np.ndarray):
        p = self.p
        at = np.cumsum(counts) - counts
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), counts))
        weight = e / np.repeat(np.add.reduceat(e, at), counts)
        z = np.add.reduceat(weight[:, None] * h, at, axis=0)
        return at, h, t, s, weight, z, 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"], -30, 30)))

    def gradient(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss, by every weight."""
        p = self.p
        at, h, t, s, weight, z, score = self._forward(x, counts)
        error = (score - y) / len(y)
        dz = np.repeat(error[:, None] * p["c"], counts, axis=0)
        dw = (dz * h).sum(axis=1)
        de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, at), counts))
        dts = de[:, None] * p["a"]
        dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
        dh = (weight[:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ error, "d": np.array([error.sum()])}

    def _fit(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray, epochs: int) -> None:
        p = self.p
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        for step in range(1, epochs + 1):
            for k, g in self.gradient(x, counts, y).items():
                g = g + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self._forward(self._scaled(x), counts)[-1]


_made: dict = {}


def _hasher() -> C.WordHasher:
    if "h" not in _made:
        _made["h"] = C.WordHasher(C.WHITE, C.LOWER)
    return _made["h"]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS, most: int = SAMPLE_PASSAGES) -> Bag | None:
    """The model, learned from the sample that labels.sample() chooses; None without two classes of labels."""
    C.prepare(docs.sparkSession)

    def run(batches):
        for batch in C.slices(batches, 1):
            x, counts = passages([t or b"" for t in batch.column(1).to_pylist()], _hasher())
            begin = np.cumsum(counts) - counts
            # Of a long text `most` passages, spread evenly.
            blobs = [x[b + np.arange(min(n, most)) * n // min(n, most)].astype(np.float16).tobytes() if n else b"" for b, n in zip(begin.tolist(), counts.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(blobs, pa.binary())], names=["y", "x"])

    got = C.arrow_map(sample(docs, labels, label, MOD, HELD_OUT, rows), run, "y int, x binary").collect()
    got.sort(key=lambda r: (bytes(r.x), r.y))
    y = np.array([r.y for r in got])
    if len(set(y.tolist())) < 2:
        return None
    x = np.concatenate([np.frombuffer(r.x, dtype=np.float16).reshape(-1, SIZE) for r in got]).astype(np.float32)
    return Bag(x, np.array([len(r.x) // (2 * SIZE) for r in got]), y)


def score(docs: DataFrame, model: Bag | None, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id and score of every row; with keep=True all columns of `docs` and `_score`."""
    C.prepare(docs.sparkSession)
    name = "_score" if keep else "score"
    own = [c for c in docs.columns if c != text_col] if keep else []
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in C.slices(batches, 1):
            if model is None:
                scores = np.full(batch.num_rows, 0.5)
            else:
                scores = model.score(*passages([t or b"" for t in batch.column(1).to_pylist()], _hasher()))
            columns = [batch.column(i + 2) for i in range(len(own))] if keep else [batch.column(0).cast(pa.int64())]
            if keep:
                columns.insert(at, batch.column(1).cast(pa.string()))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=[*(f"c{i}" for i in range(len(columns))), name] if keep else ["doc_id", name])

    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("body"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)])
    if not keep:
        return C.arrow_map(picked, run, "doc_id long, score double")
    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([StructField(f"c{i}", f.dataType) for i, f in enumerate(docs.schema.fields)] + [StructField(name, DoubleType())])
    return C.arrow_map(picked, run, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(C.fold_of("doc_id", MOD) == HELD_OUT, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of `docs` that the classifier accepts, with their columns; all rows if no model can be fitted, as nothing was rejected then."""
    model = fit(docs, labels)
    if model is None:
        return docs
    scored = score(docs, model, keep=True)
    return scored.where(F.col("_score") >= THRESHOLD).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])
