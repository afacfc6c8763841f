"""Quality classifier: gated-attention multiple-instance learning over passages."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ._common import crc_remainder, cut, map_arrow, text_of

PASSAGE_WORDS = 64
#: bound of the labelled sample that the model is fitted on (different id and text)
TRAIN_DOCS = 6000
#: passages of a row of the training table; longer documents have several rows
CHUNK_PASSAGES = 4096
#: a share of the sample that one task trains on in an epoch has about this many documents, at most TRAIN_SLOTS shares
SLOT_DOCS, TRAIN_SLOTS = 750, 8
HIDDEN, ATTENTION = 24, 12
#: a document is kept when its score reaches this
ACCEPT_AT = 0.3

_N_BYTE = 129           # 128 ASCII codes, and one for the rest
_N_SHAPE = 8
N_FEATURES = _N_BYTE + _N_SHAPE

# one fixed pseudo-random multiplier per byte and per place in a word, for word hashes
_MIX = np.random.default_rng(17).integers(1, 2**63, size=(2, 256), dtype=np.uint64) | np.uint64(1)


def encode_passages(text: bytes, words_each: int = PASSAGE_WORDS) -> np.ndarray:
    """One feature row per passage of ``words_each`` words; a text without words has one row of zeros.

    Features: shares of the bytes, and word shape measures (repetition within the
    passage, immediate repetition, mean length, share of capitals, digits,
    words without letters, words ending in a sign, and size of the passage).
    """
    b = np.frombuffer(text, dtype=np.uint8)
    space = (b == 32) | ((b >= 9) & (b <= 13))
    solid = ~space
    first = solid.copy()
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    n_words = len(at)
    if not n_words:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    where = np.flatnonzero(solid)
    word = np.cumsum(first)[where] - 1
    chars = b[where]
    passage = word // words_each
    n = int(passage[-1]) + 1
    out = np.zeros((n, N_FEATURES), dtype=np.float32)
    sizes = np.bincount(passage, minlength=n)
    kind = np.minimum(chars, 128).astype(np.int64)
    hist = np.bincount(passage * _N_BYTE + kind, minlength=n * _N_BYTE).reshape(n, _N_BYTE)
    out[:, :_N_BYTE] = hist / sizes[:, None]

    begin = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    length = np.diff(np.append(begin, len(word)))
    place = np.arange(len(word)) - np.repeat(begin, length)
    h = np.add.reduceat(_MIX[0][chars] * _MIX[1][place & 255], begin)
    of = np.arange(n_words) // words_each
    count = np.bincount(of, minlength=n)
    order = np.lexsort((h, of))
    new = np.concatenate(([True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])))
    distinct = np.bincount(of[order][new], minlength=n)
    again = np.concatenate(([False], (h[1:] == h[:-1]) & (of[1:] == of[:-1])))
    letter = ((chars | 32) >= 97) & ((chars | 32) <= 122) | (chars >= 128)
    bare = np.add.reduceat(letter.astype(np.int64), begin) == 0
    last = chars[begin + length - 1]
    sign = ~(((last | 32) >= 97) & ((last | 32) <= 122) | (last >= 128) | ((last >= 48) & (last <= 57)))
    upper = (chars >= 65) & (chars <= 90)
    digit = (chars >= 48) & (chars <= 57)
    shape = out[:, _N_BYTE:]
    shape[:, 0] = 1 - distinct / count
    shape[:, 1] = np.bincount(of, weights=again, minlength=n) / count
    shape[:, 2] = sizes / count / 10
    shape[:, 3] = np.bincount(passage, weights=upper, minlength=n) / sizes
    shape[:, 4] = np.bincount(passage, weights=digit, minlength=n) / sizes
    shape[:, 5] = np.bincount(of, weights=bare, minlength=n) / count
    shape[:, 6] = np.bincount(of, weights=sign, minlength=n) / count
    shape[:, 7] = count / words_each
    return out


@dataclass
class QualityModel:
    """Scale of the features, encoder W, gate V and U, attention w, and the output layer."""
    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, starts: np.ndarray, p: dict | None = None) -> dict[str, np.ndarray]:
        """Passages of several documents (document i from ``starts[i]`` on) to probabilities of label 1."""
        p = p or self.p
        n = np.diff(np.append(starts, len(x)))
        doc = np.repeat(np.arange(len(starts)), n)
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (tv * su) @ p["w"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        a = e / np.add.reduceat(e, starts)[doc]
        z = np.add.reduceat(a[:, None] * h, starts)
        logit = z @ p["o"] + p["c"][0]
        return {"doc": doc, "h": h, "tv": tv, "su": su, "a": a, "z": z,
                "y": 1 / (1 + np.exp(-np.clip(logit, -30, 30)))}

    def score(self, texts: list[bytes]) -> np.ndarray:
        feats = [encode_passages(t) for t in texts]
        starts = np.cumsum([0] + [len(f) for f in feats[:-1]])
        x = (np.concatenate(feats) - self.mean) / self.scale
        return self.forward(np.clip(x, -8, 8), starts)["y"]


def _logit_gradients(m: QualityModel, parts: Iterable[np.ndarray]) -> tuple[float, dict[str, np.ndarray]]:
    """Log odds of one document and their gradients, in one pass over blocks of its passages.

    With attention a = u / sum(u), u = exp(e), and q = h . o, the gradient is the mean under a of
    dq + (q - mean q) de: three sums weighted by u, which are scaled down whenever a block holds
    a larger e.  So no document is held whole, however long it is.
    """
    p = m.p
    top, total, q_sum = -np.inf, 0.0, 0.0
    rise: dict[str, np.ndarray] | None = None        # sum of u dq + u q de
    drift: dict[str, np.ndarray] | None = None       # sum of u de
    for raw in parts:
        x = np.clip((raw.astype(np.float64) - m.mean) / m.scale, -8, 8)
        h = np.tanh(x @ p["W"] + p["b"])
        tv, su = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e, q = (tv * su) @ p["w"], h @ p["o"]
        high = max(top, float(e.max()))
        u, old = np.exp(e - high), np.exp(top - high)
        top, total, q_sum = high, total * old + u.sum(), q_sum * old + u @ q
        dv, du = p["w"] * su * (1 - tv ** 2), p["w"] * tv * su * (1 - su)
        dh_e, slope = dv @ p["V"].T + du @ p["U"].T, 1 - h ** 2

        def pulled(weight: np.ndarray, direct: np.ndarray | None) -> dict[str, np.ndarray]:
            """Gradients of the sum of ``weight`` e, and of ``direct`` q where given."""
            k = weight[:, None]
            dh = k * dh_e + (direct[:, None] * p["o"] if direct is not None else 0)
            dx = dh * slope
            return {"W": x.T @ dx, "b": dx.sum(0), "V": h.T @ (k * dv), "U": h.T @ (k * du), "w": weight @ (tv * su),
                    "o": direct @ h if direct is not None else np.zeros(HIDDEN)}

        here, there = pulled(u * q, u), pulled(u, None)
        rise = here if rise is None else {k: rise[k] * old + here[k] for k in here}
        drift = there if drift is None else {k: drift[k] * old + there[k] for k in there}
    mean_q = q_sum / total
    g = {k: (rise[k] - mean_q * drift[k]) / total for k in rise}
    g["c"] = np.ones(1)
    return mean_q + p["c"][0], g


@dataclass
class Adam:
    """Parameters under training with their running moments; ``step`` counts the updates."""
    p: dict[str, np.ndarray]
    first: dict[str, np.ndarray]
    second: dict[str, np.ndarray]
    step: int = 0

    def update(self, g: dict[str, np.ndarray], rate: float, decay: float) -> None:
        self.step += 1
        for k in self.p:
            gk = g[k] + (decay * self.p[k] if k in ("W", "V", "U", "o") else 0)
            self.first[k] = self.first[k] + 0.1 * (gk - self.first[k])
            self.second[k] = self.second[k] + 0.001 * (gk * gk - self.second[k])
            grown = np.sqrt(self.second[k] / (1 - 0.999 ** self.step)) + 1e-8
            self.p[k] = self.p[k] - rate * (self.first[k] / (1 - 0.9 ** self.step)) / grown

    def pack(self) -> bytes:
        return np.concatenate([np.ravel(d[k]) for d in (self.p, self.first, self.second) for k in sorted(d)]).astype("<f8").tobytes()

    def unpacked(self, values: np.ndarray, step: int) -> Adam:
        """The same shapes with other values."""
        out, at = [], 0
        for d in (self.p, self.first, self.second):
            new = {}
            for k in sorted(d):
                new[k] = values[at:at + d[k].size].reshape(d[k].shape)
                at += d[k].size
            out.append(new)
        return Adam(*out, step)


def _documents(rows: Iterable[tuple]) -> Iterator[tuple[int, int, Iterator[np.ndarray]]]:
    """Sorted (slot, id, hash, label, passages) rows as one (slot, label, blocks of passages) per document."""
    for (slot, _, _, y), parts in groupby(rows, key=lambda r: r[:4]):
        yield slot, y, (np.frombuffer(r[4], "<f4").reshape(-1, N_FEATURES) for r in parts)


def _epoch(state: Adam, mean: np.ndarray, scale: np.ndarray, rows: Iterable[tuple], batch: int, rate: float,
           decay: float) -> Iterator[tuple[int, int, int, bytes]]:
    """One pass of each slot's documents from the same state on: slot, documents, steps, new state."""
    for slot, docs in groupby(_documents(rows), key=lambda d: d[0]):
        own, n = state.unpacked(np.frombuffer(state.pack(), "<f8"), state.step), 0
        model, held = QualityModel(mean, scale, own.p), []
        total: dict[str, np.ndarray] = {}

        def close() -> None:
            own.update({k: v / len(held) for k, v in total.items()}, rate, decay)
            held.clear()
            total.clear()
        for _, y, parts in docs:
            logit, g = _logit_gradients(model, parts)
            miss = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y
            for k, v in g.items():
                total[k] = total[k] + miss * v if k in total else miss * v
            held.append(y)
            n += 1
            if len(held) == batch:
                close()
        if held:
            close()
        yield slot, n, own.step, own.pack()


def fit_mil(passages: DataFrame, epochs: int = 14, batch: int = 16, rate: float = 4e-3,
            decay: float = 1e-3, seed: int = 5) -> QualityModel:
    """Adam on the log loss of the documents; without rows, or with one class, a constant model.

    ``passages`` has rows (slot, id, th, y, part, x).  In every epoch each slot's
    documents are trained on by one task, in an order of that epoch, from the
    common state on; the states are then averaged, weighted by documents.  The
    driver sees ``TRAIN_SLOTS`` states an epoch, never a passage.  Slots and
    orders come from hashes, so a task that runs again gives the same state.
    """
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for b in batches:
            for v in b.column(0):
                x = np.frombuffer(v.as_py(), "<f4").reshape(-1, N_FEATURES).astype(np.float64)
                n, total, square = n + len(x), total + x.sum(0), square + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"n": [n], "s": [np.concatenate([total, square]).tobytes()]})

    rng = np.random.default_rng(seed)
    seen = passages.where("part = 0").agg(F.avg("y").cast("double").alias("share"), F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    base = float(np.clip(0.5 if seen.share is None else seen.share, 1e-3, 1 - 1e-3))
    p = {"W": rng.normal(0, 0.1, (N_FEATURES, HIDDEN)), "b": np.zeros(HIDDEN),
         "V": rng.normal(0, 0.3, (HIDDEN, ATTENTION)), "U": rng.normal(0, 0.3, (HIDDEN, ATTENTION)),
         "w": rng.normal(0, 0.3, ATTENTION), "o": np.zeros(HIDDEN), "c": np.array([np.log(base / (1 - base))])}
    if seen.share is None or seen.lo == seen.hi:
        return QualityModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), p)
    moments = map_arrow(passages.select("x").repartition(TRAIN_SLOTS, F.xxhash64("x")), sums, "n long, s binary").collect()
    count = sum(r.n for r in moments)
    total, square = np.sum([np.frombuffer(r.s) for r in moments], axis=0).reshape(2, N_FEATURES)
    mean = total / count
    scale = np.sqrt(np.maximum(square / count - mean ** 2, 0)) + 1e-3
    state = Adam(p, *({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2)))
    for epoch in range(epochs):
        ordered = (passages.repartition(TRAIN_SLOTS, "slot")
                   .sortWithinPartitions("slot", F.xxhash64("id", "th", F.lit(epoch)), "id", "th", "part")
                   .select("slot", "id", "th", "y", "x"))

        def run(batches: Iterator[pa.RecordBatch], now: Adam = state) -> Iterator[pa.RecordBatch]:
            rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
            for slot, n, step, packed in _epoch(now, mean, scale, rows, batch, rate, decay):
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([n], pa.int64()), pa.array([step], pa.int64()),
                                                  pa.array([packed], pa.binary())], names=["slot", "n", "step", "state"])
        new = sorted(map_arrow(ordered, run, "slot int, n long, step long, state binary").collect())
        weights = np.array([r.n for r in new], dtype=np.float64)
        values = np.average([np.frombuffer(r.state, "<f8") for r in new], axis=0, weights=weights)
        state = state.unpacked(values, max(r.step for r in new))
    return QualityModel(mean, scale, state.p)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", held_out_modulus: int = 5, max_docs: int = TRAIN_DOCS) -> QualityModel:
    """Fit on labelled documents whose crc32(id as text) modulo ``held_out_modulus`` is not 0.

    The fit uses a bounded sample of rows: ``max_docs`` labelled ids, those of
    smallest hash (the same at every run), and of their rows, one per id and text,
    again ``max_docs`` of smallest hash.  Every passage of those rows is trained
    on, by tasks that read the passages from a table in the shared folder.  Rows with a null id or label do not count; of
    several labels of an id the mean, rounded up from one half, counts.  Without
    usable labels the model is constant.
    """
    sample = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
              .where(crc_remainder(id_col, held_out_modulus) != 0)
              .groupBy(F.col(id_col).alias("_label_id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("_y"))
              .orderBy(F.xxhash64("_label_id"), "_label_id").limit(max_docs))
    texts = docs.select(F.col(id_col).alias("_doc"), F.xxhash64(text_of(text_col)).alias("_th"), text_of(text_col).alias("_t"))
    keys = cut(texts.select("_doc", "_th").join(F.broadcast(sample), F.col("_doc") == F.col("_label_id"))
               .select("_doc", "_th", "_y").distinct()
               .orderBy(F.xxhash64("_doc", "_th"), "_doc", "_th").limit(max_docs))
    keys = keys.select(F.col("_doc").alias("_label_id"), F.col("_th").alias("_label_th"), "_y")
    picked = (texts.join(F.broadcast(keys), (F.col("_doc") == F.col("_label_id")) & (F.col("_th") == F.col("_label_th")))
              .dropDuplicates(["_doc", "_th"]).select("_doc", "_th", "_y", F.encode("_t", "UTF-8").alias("_t")))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = encode_passages(b.column(3)[i].as_py()).astype("<f4")
                row = b.slice(i, 1)
                for part, at in enumerate(range(0, len(x), CHUNK_PASSAGES)):
                    yield pa.RecordBatch.from_arrays(
                        [row.column(0), row.column(1), row.column(2), pa.array([part], pa.int32()),
                         pa.array([x[at:at + CHUNK_PASSAGES].tobytes()], pa.binary())], names=["id", "th", "y", "part", "x"])

    passages = map_arrow(picked, run, f"id {id_type}, th long, y int, part int, x binary")
    slots = max(1, min(TRAIN_SLOTS, keys.count() // SLOT_DOCS))
    slot = F.pmod(F.xxhash64("th", "id"), F.lit(slots)).cast("int").alias("slot")
    return fit_mil(cut(passages.select(slot, "*")))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 as a last column, from the whole text of every row.

    Null and empty texts are scored as one empty passage.  A column of ``docs``
    named like ``score_col`` is replaced.  No other column enters the score.
    """
    rest = docs.drop(score_col)
    names = rest.columns
    at = names.index(text_col)
    text_type = rest.schema[text_col].dataType.simpleString()
    src = rest if text_type == "string" else rest.withColumn(text_col, F.col(text_col).cast("string"))
    schema = StructType([*src.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [b"" if t is None else t for t in b.column(at).cast(pa.binary()).to_pylist()]
            out = np.empty(len(texts))
            for i in range(0, len(texts), 32):      # a few documents at a time: bounded feature matrices
                out[i:i + 32] = model.score(texts[i:i + 32])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], names=[*names, score_col])

    return map_arrow(src, run, schema)
