"""Hard-negative mining with rotated one-bit codes and exact integer scores."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, map_arrow, map_groups

#: one-bit codes per vector, each of what the codes before leave over
LEVELS = 6
#: bits of an anchor's rotated components, read plane by plane against the codes
PLANES = 8
#: vectors in a block of rows and of anchors: blocks grow in number, not in size
ROW_BLOCK, ANCHOR_BLOCK = 16384, 2048
#: components from here on (after scaling) have no 64-bit score
LIMIT = 1 << 22
_STRIP = 32


@lru_cache(maxsize=64)
def rotation(dim: int, level: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng([23, dim, level]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits (n, dim) as 64-bit words (n, words)."""
    n, dim = bits.shape
    wide = np.zeros((n, -(-dim // 64) * 64), dtype=bool)
    wide[:, :dim] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def unit_rows(q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = q.astype(np.float64)
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norm > 0, norm, 1)[:, None], norm


def encode(q: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, ...]:
    """(codes, alignments, rest, norm): signs of the rotated unit vector, how far the vector
    reaches along each code vector, and the length of what all codes leave over."""
    left, norm = unit_rows(q)
    n, dim = q.shape
    codes, along = [], []
    for j in range(levels):
        r = rotation(dim, j)
        y = left @ r
        s = y >= 0
        code = np.where(s, 1.0, -1.0) / dim ** 0.5
        a = np.einsum("ij,ij->i", y, code)
        left = left - (a[:, None] * code) @ r.T
        codes.append(_words(s))
        along.append(a)
    return np.stack(codes, 1), np.stack(along, 1), np.sqrt(np.einsum("ij,ij->i", left, left)), norm


class Anchors:
    """Unit anchors rotated at every level, their components in ``PLANES`` bits."""

    def __init__(self, q: np.ndarray, levels: int):
        u, self.norm = unit_rows(q)
        self.dim, self.planes, self.low, self.step, self.total, self.off = q.shape[1], [], [], [], [], []
        for j in range(levels):
            w = u @ rotation(self.dim, j)
            low, high = w.min(1, keepdims=True), w.max(1, keepdims=True)
            step = np.where(high > low, (high - low) / ((1 << PLANES) - 1), 1.0)
            t = np.clip(np.rint((w - low) / step), 0, (1 << PLANES) - 1).astype(np.int64)
            self.planes.append([_words(t >> p & 1 == 1) for p in range(PLANES)])
            self.low.append(low[:, 0])
            self.step.append(step[:, 0])
            self.total.append(t.sum(1))
            self.off.append(np.sqrt(((w - low - step * t) ** 2).sum(1)))

    def intervals(self, at: np.ndarray, codes: np.ndarray, along: np.ndarray, rest: np.ndarray,
                  norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (anchors, rows) that hold the inner product for certain.

        With v = sum of a_j b_j + r and |u| = 1, <u, v> is the sum of a_j <u, b_j>
        within |r| (Cauchy-Schwarz).  <u, b_j> is estimated from the popcounts of
        code and bit planes, within the length of the rounding error of u.
        """
        estimate, radius = np.zeros((len(at), len(rest))), np.repeat(rest[None, :], len(at), 0)
        for j in range(codes.shape[1]):
            inner = np.zeros(estimate.shape, dtype=np.int32)
            for plane in reversed(self.planes[j]):
                inner *= 2
                for w in range(codes.shape[2]):
                    inner += np.bitwise_count(plane[at, w][:, None] & codes[None, :, j, w])
            ones = np.bitwise_count(codes[:, j]).sum(1, dtype=np.int64)
            low, step, total = (x[j][at][:, None] for x in (self.low, self.step, self.total))
            product = (low * (2 * ones - self.dim)[None, :] + step * (2 * inner - total)) / self.dim ** 0.5
            estimate += along[None, :, j] * product
            radius += along[None, :, j] * self.off[j][at][:, None]
        scale = self.norm[at][:, None] * norm[None, :]
        radius = (radius + 1e-9) * scale + 1e-6
        return estimate * scale - radius, estimate * scale + radius


def _least(lower: np.ndarray, k: int) -> float:
    """The k-th largest certain score: nothing below it is among the first k."""
    return float(np.partition(lower, -k)[-k]) if len(lower) >= k else -np.inf


def first_positives(a: dict, r: dict, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, id, score) of each anchor's first k rows of its label in a block, the anchor's own id left out."""
    coded = Anchors(a["q"], r["codes"].shape[1])
    for label in np.intersect1d(a["label"], r["label"]):
        rows = np.flatnonzero(r["label"] == label)
        own = np.flatnonzero(a["label"] == label)
        for s in range(0, len(own), _STRIP):
            at = own[s:s + _STRIP]
            lower, upper = coded.intervals(at, *(r[c][rows] for c in ("codes", "along", "rest", "norm")))
            for x, i in enumerate(at):
                other = r["id"][rows] != a["id"][i]
                on = rows[other & (upper[x] >= _least(lower[x][other], k))]
                score = r["q"][on] @ a["q"][i]
                first = np.lexsort((r["id"][on], -score))[:k]
                yield np.full(len(first), a["key"][i]), r["id"][on][first], score[first]


def first_negatives(a: dict, r: dict, k: int, low: int, high: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(key, place of the positive, id, score) of the first k rows in range for each anchor and positive in a block."""
    coded = Anchors(a["q"], r["codes"].shape[1])
    for s in range(0, len(a["q"]), _STRIP):
        at = np.arange(s, min(s + _STRIP, len(a["q"])))
        lower, upper = coded.intervals(at, r["codes"], r["along"], r["rest"], r["norm"])
        for x, i in enumerate(at):
            foreign = r["label"] != a["label"][i]
            rows = np.flatnonzero(foreign)
            lo, up = lower[x][rows], upper[x][rows]
            for place, positive in enumerate(a["scores"][i]):
                floor, top = low * positive / 100, high * positive / 100
                may = (up >= floor - 1) & (lo <= top + 1)
                sure = (lo >= floor) & (up <= top)
                on = rows[may & (up >= _least(lo[sure], k))]
                score = r["q"][on] @ a["q"][i]
                fits = (low * positive <= 100 * score) & (100 * score <= high * positive)
                on, score = on[fits], score[fits]
                first = np.lexsort((r["id"][on], -score))[:k]
                yield (np.full(len(first), a["key"][i]), np.full(len(first), place, dtype=np.int32),
                       r["id"][on][first], score[first])


_FIELDS = {"key": "<i8", "id": "<i8", "label": "<i8", "q": "<i4", "codes": "<u8", "along": "<f8", "rest": "<f8", "norm": "<f8",
           "scores": "<i8"}


def _block(b: pa.RecordBatch, i: int, prefix: str, fields: tuple[str, ...], levels: int) -> dict:
    """The vectors of one side of a pair of blocks as arrays."""
    dim = b.column("dim")[i].as_py()
    out = {f: np.frombuffer(b.column(prefix + f)[i].as_buffer(), _FIELDS[f]) for f in fields}
    n = len(out["id"])
    out["q"] = out["q"].reshape(n, dim)
    if "codes" in out:
        out["codes"], out["along"] = out["codes"].reshape(n, levels, -1), out["along"].reshape(n, levels)
    return out


def vector_rows(vectors: DataFrame, id_col: str, label_col: str, vector_col: str, scale: int) -> DataFrame:
    """``key, id, label, dim, q`` of the rows that take part, each different one once."""
    good = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & (F.abs(x) < LIMIT / scale))
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"),
                         F.col(vector_col).cast("array<double>").alias("e"))
    src = src.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.coalesce(good, F.lit(False)))
    q = F.transform("e", lambda x: F.floor(x * scale).cast("int"))
    src = src.select("id", F.xxhash64("label").alias("label"), q.alias("q"))
    return (src.withColumn("key", F.xxhash64("id", "label", "q")).dropDuplicates(["key"])
            .select("key", "id", "label", F.size("q").alias("dim"), "q"))


def hard_negatives(vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label",
                   vector_col: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   scale: int = 256, levels: int = LEVELS) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Each component x counts as floor(scale * x); a score is the integer inner
    product with the anchor, higher first, ties by smaller id.  Anchors are the rows
    for which ``anchor`` (a column over ``id``) holds, positives the first ``positives``
    other ids of the anchor's label, and negatives of a positive the first ``negatives``
    rows of another label whose score is ``low`` to ``high`` per cent of the positive's.

    Rows with a null id, label or vector, an empty vector, a null or non-finite
    component, or one of 2^22 or more after scaling (its scores may not fit 64 bits)
    take no part.  Rows that repeat id, label and vector count once; rows that share
    only the id are rows of their own, none of them an "other" row to the rest.
    Vectors of different length never meet.  A positive whose range holds no row (any
    with a negative score) gives no rows, nor does an empty table; other columns are
    not read.

    Anchors meet all rows in blocks.  In a pair of blocks every row gets a certain
    interval for its score (``Anchors.intervals``); rows that cannot be among the
    first are left out, the others are scored in integers, and a block passes on at
    most the wanted number per anchor.  Results are exact, not approximate.
    """
    spark = vectors.sparkSession
    rows = cut(vector_rows(vectors, id_col, label_col, vector_col, scale))
    n = rows.count()
    blocks = max(1, -(-n // ROW_BLOCK), min(n // 1024, 2 * spark.sparkContext.defaultParallelism))
    row_fields = ("id", "label", "q", "codes", "along", "rest", "norm")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, labels, q = (np.concatenate(x) for x in zip(*held.pop(dim)))
            parts = (ids, labels, q.astype("<i4"), *encode(q, levels))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in parts]],
                                              names=["dim", *("r_" + f for f in row_fields)])

        for b in batches:
            ids, labels, dims = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for dim in np.unique(dims):
                own = np.flatnonzero(dims == dim)
                q = b.column(3).take(pa.array(own)).flatten().to_numpy().reshape(-1, dim)
                held.setdefault(int(dim), []).append((ids[own], labels[own], q))
                if sum(len(x) for x, _, _ in held[int(dim)]) >= ROW_BLOCK:
                    yield block(int(dim))
        for dim in list(held):
            yield block(dim)

    packed = cut(map_arrow(rows.repartition(blocks, "key").select("id", "label", "dim", "q"), pack,
                           "dim int, " + ", ".join(f"r_{f} binary" for f in row_fields)))

    def anchor_blocks(chosen: DataFrame, fields: list[str]) -> DataFrame:
        """Anchors dealt by their key into numbered blocks of about ``ANCHOR_BLOCK``."""
        sizes = chosen.groupBy("dim").agg(F.ceil(F.count("*") / ANCHOR_BLOCK).cast("int").alias("blocks"))

        def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            out = {"dim": [key[0]], "part": [key[1]], "parts": [g["blocks"].iloc[0]]}
            for f in fields:
                values = g[f].to_numpy() if f in ("key", "id", "label") else np.stack(g[f].to_list())
                out["a_" + f] = [values.astype(_FIELDS[f]).tobytes()]
            return pd.DataFrame(out)

        dealt = chosen.join(sizes, "dim").withColumn("part", F.expr("pmod(key, blocks)").cast("int"))
        return cut(map_groups(dealt.groupBy("dim", "part"), build,
                              "dim int, part int, parts int, " + ", ".join(f"a_{f} binary" for f in fields)))

    def met(blocks_of: DataFrame) -> DataFrame:
        """Every block of rows with every block of anchors of its length."""
        parts = blocks_of.groupBy("dim").agg(F.max("parts").alias("parts"))
        r = packed.join(parts, "dim").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        pairs = r.join(blocks_of.drop("parts"), ["dim", "part"])
        return pairs.repartition(min(4096, blocks * max(1, blocks_of.count())), "dim", "part", F.xxhash64("r_id"))

    first = "key", "id", "label", "q"
    chosen = cut(rows.where(anchor))
    anchors = anchor_blocks(chosen, list(first))

    def positives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, r = _block(b, i, "a_", first, levels), _block(b, i, "r_", row_fields, levels)
                a["q"] = a["q"].astype(np.int64)
                found = list(first_positives(a, r, positives))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)],
                                                     names=["key", "positive_id", "positive_score"])

    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = map_arrow(met(anchors), positives_of, "key long, positive_id long, positive_score long")
    near = cut(near.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < positives))
    # a fixed number of scores per anchor: none repeats the negative score -1, whose range is empty
    scores = near.groupBy("key").agg(F.collect_list(F.struct("place", "positive_score")).alias("s"))
    slots = F.array(*[F.coalesce(F.element_at(F.map_from_entries("s"), F.lit(p)), F.lit(-1).cast("long"))
                      for p in range(positives)])
    wanted = cut(chosen.join(scores, "key").withColumn("scores", slots).drop("s"))
    second = (*first, "scores")
    again = anchor_blocks(wanted, list(second))

    def negatives_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                a, r = _block(b, i, "a_", first, levels), _block(b, i, "r_", row_fields, levels)
                a["q"] = a["q"].astype(np.int64)
                a["scores"] = np.frombuffer(b.column("a_scores")[i].as_buffer(), "<i8").reshape(len(a["id"]), positives).tolist()
                found = list(first_negatives(a, r, negatives, low, high))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)],
                                                     names=["key", "place", "negative_id", "negative_score"])

    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = map_arrow(met(again), negatives_of, "key long, place int, negative_id long, negative_score long")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = chosen.select("key", F.col("id").alias("anchor_id"))
    return far.join(near, ["key", "place"]).join(ids, "key").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
