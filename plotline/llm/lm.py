"""Language-model scoring: a log-bilinear model with noise-contrastive estimation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import crc_remainder, cut, map_arrow, text_of

#: classes of the neural model: the most frequent tokens, and one for all others
CLASSES = 1024
DIMENSIONS = 32
NOISE = 10
STEPS = 160
#: pseudo-counts that each class row gets, spread by the class frequencies: rows with few pairs stay near them
PRIOR = 50.0
#: most frequent tokens whose counts every task holds; the others are joined
COMMON = 50_000
#: the end of a text, a token like any other; words are never empty
END = b""
_FLUSH = 400_000


def tokens_of(text: bytes) -> list[bytes]:
    words = text.lower().split()                # bytes: only A-Z and ASCII white space
    words.append(END)
    return words


def _prepared(docs: DataFrame, id_col: str, text_col: str, modulus: int, held_out: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"),
                       (crc_remainder(id_col, modulus) == held_out).alias("held_out"),
                       F.encode(text_of(text_col), "UTF-8").alias("t"))


def token_counts(texts: DataFrame) -> DataFrame:
    """``(token, c)`` over the binary column ``t``, summed in the tasks first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()),
                                               pa.array(list(counts.values()), pa.int64())], names=["token", "c"])
        for b in batches:
            for t in b.column(0):
                counts.update(tokens_of(t.as_py()))
                if len(counts) > _FLUSH:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return map_arrow(texts, run, "token binary, c long").groupBy("token").agg(F.sum("c").alias("c"))


def pair_counts(texts: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``(cell, n)``: how often class ``cell % K`` follows class ``cell // K``; a text starts after an end."""
    k = len(vocabulary) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k * k, dtype=np.int64)
        start = vocabulary.get(END, 0)
        for b in batches:
            for t in b.column(0):
                seq = np.array([start, *[vocabulary.get(w, 0) for w in tokens_of(t.as_py())]])
                cells, n = np.unique(seq[:-1] * k + seq[1:], return_counts=True)
                total[cells] += n
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], names=["cell", "n"])

    return map_arrow(texts, run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def fit_log_bilinear(counts: np.ndarray, dimensions: int = DIMENSIONS, noise: int = NOISE, steps: int = STEPS,
                     rate: float = 0.05, prior: float = PRIOR, seed: int = 3) -> np.ndarray:
    """Normalised log10 p(next | previous), a K x K table, learned from pair counts.

    The prediction for a context w is C r_w, its score for v is (C r_w) . q_v + b_v.
    Noise-contrastive estimation tells the counted pairs from ``noise`` times as
    many drawn from the smoothed class frequencies; with pair counts its
    objective is a sum over the table, so each Adam step takes all training data.
    ``prior`` pseudo-counts a row keep a small corpus from being learned by heart.
    One matrix product then gives all scores, which are normalised row by row.
    """
    k = len(counts)
    rng = np.random.default_rng(seed)
    share = (counts.sum(0) + 1.0) / (counts.sum() + k)
    counts = counts + prior * share[None, :]
    row = counts.sum(1)
    data = (counts / max(1.0, counts.sum())).astype(np.float32)
    drawn = (noise * (row / max(1.0, counts.sum()))[:, None] * share[None, :]).astype(np.float32)
    p = {"r": rng.normal(0, 0.1, (k, dimensions)), "c": np.eye(dimensions), "q": rng.normal(0, 0.1, (k, dimensions)),
         "b": np.log(share)}
    p = {n: v.astype(np.float32) for n, v in p.items()}
    first, second = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    against = (np.log(noise) + np.log(share)).astype(np.float32)
    # rows differ by orders of magnitude in weight: each parameter row is scaled by Adam
    for step in range(1, steps + 1):
        predicted = p["r"] @ p["c"]
        z = predicted @ p["q"].T + (p["b"] - against)[None, :]
        real = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = drawn * real - data * (1 - real)
        d_pred = g @ p["q"]
        grads = {"r": d_pred @ p["c"].T, "c": p["r"].T @ d_pred, "q": g.T @ predicted, "b": g.sum(0)}
        slow = rate * min(1.0, 3.0 * (steps - step + 1) / steps)
        for n in p:
            first[n] += 0.1 * (grads[n] - first[n])
            second[n] += 0.01 * (grads[n] ** 2 - second[n])
            p[n] -= (slow * (first[n] / (1 - 0.9 ** step))
                     / (np.sqrt(second[n] / (1 - 0.99 ** step)) + 1e-9)).astype(np.float32)
    scores = (p["r"] @ p["c"] @ p["q"].T + p["b"][None, :]).astype(np.float64)
    top = scores.max(1, keepdims=True)
    logs = scores - top - np.log(np.exp(scores - top).sum(1, keepdims=True))
    return (logs / np.log(10)).astype(np.float32)


@dataclass
class LanguageModel:
    """Class table, class of each frequent token, counts of the common tokens, and the totals."""
    logs: np.ndarray
    vocabulary: dict[bytes, int]
    common: dict[bytes, int]
    n: int          # training tokens
    v: int          # distinct training tokens
    rare_n: int     # tokens of the rest class
    rare_v: int     # distinct ones


def fit_language_model(texts: DataFrame, counts: DataFrame, classes: int = CLASSES,
                       common: int = COMMON) -> LanguageModel:
    """Fit on all rows of ``texts`` (binary column ``t``); ``counts`` are their token counts.

    The driver gets the ``common`` most frequent tokens and at most
    ``classes`` squared pair counts, both bounded; the counts themselves cover
    all training texts.
    """
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("c"), "token").limit(common).toArrow()
    frequent = dict(zip(top["token"].to_pylist(), top["c"].to_pylist(), strict=True))
    vocabulary = {t: i + 1 for i, t in enumerate(list(frequent)[:classes - 1])}
    k = len(vocabulary) + 1
    table = np.zeros(k * k)
    pairs = pair_counts(texts, vocabulary).toArrow()
    table[pairs["cell"].to_numpy()] = pairs["n"].to_numpy()
    del pairs
    held = sum(frequent[t] for t in vocabulary)
    return LanguageModel(fit_log_bilinear(table.reshape(k, k)), vocabulary, frequent, total.n, total.v,
                         total.n - held, total.v - len(vocabulary))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, held_out: int = 2,
                classes: int = CLASSES, common: int = COMMON) -> DataFrame:
    """One row per input row: ``id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32(id as text; null: empty) modulo ``modulus`` is ``held_out``
    teach nothing.  ``base_score`` is the add-one unigram log10 probability,
    ``score`` the model's: each token's class given the class before by the
    log-bilinear model, and for a token of the rest class its share of that class by
    add-one counts, one place being kept for tokens never seen.  Both
    distributions sum to one over the training tokens and "unseen".

    Counts of the ``common`` most frequent tokens are sent to the tasks; the
    others are joined by token, no single one of which can be a hot key then.
    Null and empty texts are one end token.  Without training rows the counts are
    zero and nothing is known.  Rows alike in id and text get the same scores.
    """
    rows = _prepared(docs, id_col, text_col, modulus, held_out)
    train = rows.where("not held_out").select("t")
    counts = cut(token_counts(train))
    model = fit_language_model(train, counts, classes, common)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("token", pa.binary()), ("n", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        start = m.vocabulary.get(END, 0)
        base_all, rare_all = np.log10(m.n + m.v + 1), np.log10(m.rare_n + m.rare_v + 1)
        log_of = {t: np.log10(c + 1) for t, c in m.common.items()}
        for b in (whole.slice(at, 512) for whole in batches for at in range(0, whole.num_rows, 512)):
            cols: list[list] = [[] for _ in range(5)]
            for t in b.column(3):
                tokens = tokens_of(t.as_py())
                seq = np.array([start, *[m.vocabulary.get(w, 0) for w in tokens]])
                score = float(m.logs[seq[:-1], seq[1:]].sum(dtype=np.float64))
                base, known, rest = 0.0, 0, []
                for w, n in Counter(tokens).items():
                    share = log_of.get(w)
                    if share is None:
                        rest.append({"token": w, "n": n})
                        base -= n * base_all
                        score -= n * rare_all
                    else:
                        known += n
                        base += n * (share - base_all)
                        if w not in m.vocabulary:
                            score += n * (share - rare_all)
                for c, v in zip(cols, (len(tokens), known, base, score, rest), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                 pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], kind)],
                names=["id", "th", "held_out", "n_tokens", "known", "base", "score", "rest"])

    part = cut(map_arrow(rows, run, f"id {id_type}, th long, held_out boolean, n_tokens long, known long, "
                                    "base double, score double, rest array<struct<token:binary,n:long>>"))
    rest = part.select("id", "th", F.explode("rest").alias("r")).select("id", "th", "r.token", "r.n")
    looked = rest.join(counts, "token").select(
        "id", "th", F.lit(0).alias("one"), F.col("n").alias("known"), (F.col("n") * F.log10(F.col("c") + 1)).alias("gain"))
    each = part.select("id", "th", F.lit(1).alias("one"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("gain"))
    # sums over rows alike in id and text, divided by their number
    more = cut(looked.unionByName(each).groupBy("id", "th").agg(
        F.sum("one").alias("rows"), F.sum("known").alias("more"), F.sum("gain").alias("gain"))
        .select(F.col("id").alias("_id"), F.col("th").alias("_th"), (F.col("more") / F.col("rows")).cast("long")
                .alias("more"), (F.col("gain") / F.col("rows")).alias("gain")))
    out = part.drop("rest").join(more, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    return out.select("id", "held_out", "n_tokens", (F.col("known") + F.col("more")).alias("n_known"),
                      F.lit(model.n).cast("long").alias("train_tokens"),
                      (F.col("base") + F.col("gain")).alias("base_score"), (F.col("score") + F.col("gain")).alias("score"))
