"""Embedding near-dedup by collision-counting projections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, discard, map_arrow
from .components import connected_components

#: different vectors in a block, on average: blocks grow in number, not in size
BLOCK = 4096
_STRIP = 64


def projections(dim: int, seed: int = 11) -> np.ndarray:
    """An orthonormal set of ``dim`` directions (a seeded random rotation)."""
    q, r = np.linalg.qr(np.random.default_rng([seed, dim]).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def calibration(threshold: float) -> tuple[float, int]:
    """Half-width of the window and most projections that may miss it, at full recall.

    Unit vectors of cosine >= t are at most D = 2 - 2t apart (squared), and over
    orthonormal directions the squared differences sum to at most D.  So at most
    D / w**2 of them can exceed w: a pair colliding in fewer than all but that
    many projections is no link.
    """
    d = 2 - 2 * threshold
    return (d / 5) ** 0.5, 5


def codes(values: np.ndarray) -> np.ndarray:
    """Projections of unit vectors (-1 to 1) in 254 steps."""
    return np.floor((np.clip(values, -1, 1) + 1) * 127).astype(np.uint8)


def near_rows(strip: np.ndarray, lead: np.ndarray, threshold: float) -> tuple[int, int]:
    """Rows, by their sorted first projection, no farther from a strip than two linked vectors can be."""
    reach = int(np.ceil((2 - 2 * threshold) ** 0.5 * 127)) + 1
    return (int(np.searchsorted(lead, max(0, int(strip[0]) - reach), "left")),
            int(np.searchsorted(lead, min(255, int(strip[-1]) + reach), "right")))


def linked_pairs(xa: np.ndarray, ca: np.ndarray, xb: np.ndarray, cb: np.ndarray, threshold: float,
                 same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two blocks, each sorted by its first projection, with cosine >= threshold.

    Rows out of reach in the sorted first projection are not looked at.  For the
    others the collisions with the window around each row are counted projection
    by projection; those still able to pass after the first 48 go on alone.
    Survivors are verified by their cosine.
    """
    width, misses = calibration(threshold)
    w = int(np.ceil(width * 127)) + 1               # codes of close values differ by one step more at most
    dim = ca.shape[1]
    dense = min(dim, 48)
    cbt = np.ascontiguousarray(cb.T)
    left, right = [], []
    for at in range(0, len(ca), _STRIP):
        strip = ca[at:at + _STRIP]
        lo, hi = (at, len(cb)) if same else near_rows(strip[:, 0], cb[:, 0], threshold)
        missed = np.zeros((len(strip), hi - lo), dtype=np.uint8)
        gap, far = np.empty_like(missed), np.empty(missed.shape, dtype=bool)
        for j in range(dense):
            np.subtract(strip[:, j, None] + np.uint8(w), cbt[j, None, lo:hi], out=gap)
            np.greater(gap, np.uint8(2 * w), out=far)
            np.add(missed, far.view(np.uint8), out=missed)
        i, k = np.nonzero(missed <= misses)
        count = missed[i, k].astype(np.int64)
        for j in range(dense, dim, 16):
            apart = np.abs(strip[i, j:j + 16].astype(np.int16) - cb[k + lo, j:j + 16].astype(np.int16)) > w
            count += apart.sum(1)
            on = count <= misses
            i, k, count = i[on], k[on], count[on]
        i, k = i + at, k + lo
        if same:
            i, k = i[k > i], k[k > i]
        for s in range(0, len(i), 100_000):
            a, b = i[s:s + 100_000], k[s:s + 100_000]
            on = np.einsum("ij,ij->i", xa[a], xb[b]) >= threshold
            left.append(a[on])
            right.append(b[on])
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(left) if left else none), (np.concatenate(right) if right else none)


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of ``n`` nodes over the given links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def unit_rows(raw: bytes, dim: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by the first projection's code, and so ordered the unit vectors and codes of a block."""
    x = np.frombuffer(raw, kind).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(axis=1, keepdims=True)
    x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    c = codes(x @ projections(dim))
    order = np.argsort(c[:, 0], kind="stable")
    return order, x[order], c[order]


def _parts(blocks: int) -> int:
    """Partitions of the table of blocks, whose square is the number of tasks that compare them."""
    return max(1, min(blocks, 256, max(16, -(-blocks // 8))))


def embedding_links(reps: DataFrame, threshold: float = 0.9, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Link counts ``(node, links)`` and connecting edges ``(a, b)`` of different valid vectors.

    ``reps`` has ``node`` (long), ``weight`` (rows holding the vector) and ``e``
    (array of float or double).  Vectors are cut at the quantiles of their first
    projection into blocks of about ``block`` rows; every pair of blocks of one
    dimension meets once.  The blocks are dealt once and the tasks, one per pair
    of partitions, read the two they compare: a block is never written per pair,
    so disk grows with the rows, not with their square.  Counting, verification
    and weights stay inside the task, which returns a count per vector and a
    spanning forest, never the pairs.
    """
    kind = "<f4" if reps.schema["e"].dataType.elementType.typeName() == "float" else "<f8"

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            dims = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
            at = np.concatenate(([0], np.cumsum(dims)))
            raw, lead = [], []
            for x, y in zip(at[:-1], at[1:]):
                v = flat[x:y].astype(np.float64)
                v = v / np.abs(v).max()
                lead.append(v @ first(len(v)) / np.sqrt(v @ v))
                raw.append(flat[x:y].tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(dims.astype(np.int32)), pa.array(lead, pa.float64()),
                 pa.array(raw, pa.binary())], names=["node", "weight", "dim", "lead", "raw"])

    known: dict[int, np.ndarray] = {}

    def first(dim: int) -> np.ndarray:
        if dim not in known:
            known[dim] = projections(dim)[:, 0].copy()
        return known[dim]

    fields = "node long, weight long, dim int, lead double, raw binary"
    rows = map_arrow(reps.select("node", "weight", "e"), project, fields)
    # cuts of the first projection: as many numbers as there are blocks
    sizes = {r.dim: r["count"] for r in reps.groupBy(F.size("e").alias("dim")).count().collect()}
    edges: dict[int, np.ndarray] = {}
    for dim, n in sizes.items():
        parts = max(1, -(-n // block))
        inner = [i / parts for i in range(1, parts)]
        cuts = rows.where(F.col("dim") == dim).approxQuantile("lead", inner, 0.1 / parts) if inner else []
        edges[dim] = np.unique(np.array(cuts, dtype=np.float64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, lead = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
            at = np.zeros(len(dims), dtype=np.int32)
            for dim, cuts in edges.items():
                own = dims == dim
                at[own] = np.searchsorted(cuts, lead[own], "right")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=[*b.schema.names, "block"])

    def build(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "block": [key[1]], "nodes": [g["node"].to_numpy("<i8").tobytes()],
                             "weights": [g["weight"].to_numpy("<i8").tobytes()], "raw": [b"".join(g["raw"])]})

    dealt = map_arrow(rows, deal, f"{fields}, block int").drop("lead")
    blocks = cut(dealt.groupBy("dim", "block").applyInPandas(
        build, "dim int, block int, nodes binary, weights binary, raw binary"))
    spread = blocks.repartition(_parts(sum(len(e) + 1 for e in edges.values())))
    other = spread.select(F.col("dim").alias("dim2"), F.col("block").alias("other"), F.col("nodes").alias("nodes2"),
                          F.col("weights").alias("weights2"), F.col("raw").alias("raw2"))
    # each pair on one side of the diagonal, by turns, so that all tasks have work
    once = (F.col("block") == F.col("other")) | (
        (F.col("block") < F.col("other")) == ((F.col("block") + F.col("other")) % 2 == 0))
    met = (spread.join(other.hint("shuffle_replicate_nl"), (F.col("dim") == F.col("dim2")) & once)
           .select("dim", "block", "other", "nodes", "weights", "raw", "nodes2", "weights2", "raw2"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                dim, i, j = (b.column(c)[r].as_py() for c in range(3))
                raw = [b.column(c)[r].as_py() for c in range(3, 9)]
                oa, xa, ca = unit_rows(raw[2], dim, kind)
                ob, xb, cb = (oa, xa, ca) if i == j else unit_rows(raw[5], dim, kind)
                na, wa, nb, wb = (np.frombuffer(raw[c], "<i8")[o] for c, o in ((0, oa), (1, oa), (3, ob), (4, ob)))
                x, y = linked_pairs(xa, ca, xb, cb, threshold, i == j)
                links = np.bincount(x, weights=wb[y], minlength=len(na)).astype(np.int64)
                back = np.bincount(y, weights=wa[x], minlength=len(nb)).astype(np.int64)
                if i == j:
                    node, n, tree = na, links + back, _forest(len(na), x, y)
                else:
                    node, n = np.concatenate((na, nb)), np.concatenate((links, back))
                    tree = _forest(len(node), x, y + len(na))
                on = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(node[on]), pa.array(node[tree[on]]), pa.array(n[on])],
                                                 names=["a", "b", "n"])

    found = cut(map_arrow(met, count, "a long, b long, n long"))
    discard(blocks)
    return (found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("links")),
            found.select("a", "b").where("a <> b").distinct())


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    threshold: float = 0.9, block: int = BLOCK) -> DataFrame:
    """One row per input row: ``id, n_links, component_id, kept``.

    Rows link when their vectors' cosine, in double precision, is at least
    ``threshold``.  A vector that is null, empty, zero, or has a null or
    non-finite component links with nothing, and vectors of different length never
    link.  ``component_id`` is the smallest id reachable (null ids are ignored);
    ``kept`` says that it is the row's own.  Rows holding one and the same vector
    are folded to one with a weight before any comparison, however many they
    are.  Recall is complete by construction (see ``calibration``).  An empty
    table gives an empty result; other columns are not read.
    """
    good = (F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floats stay floats on the way, they are half as wide
    item = "float" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "double"
    src = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast(f"array<{item}>").alias("e"))
    src = src.withColumn("ok", F.coalesce(good & F.exists("e", lambda x: x != 0), F.lit(False)))
    src = src.select("id", F.when(F.col("ok"), F.col("e")).alias("e"), F.when(F.col("ok"), F.xxhash64("e")).alias("node"))
    reps = cut(src.where("node is not null").groupBy("node").agg(F.count("*").alias("weight"), F.first("e").alias("e")))
    links, edges = embedding_links(reps, threshold, block)
    comp = connected_components(edges)
    names = cut(reps.select("node", "weight").join(links, "node", "left").join(comp, "node", "left").select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "node").alias("root")))
    rows = cut(src.select("id", "node").join(names, "node", "left"))
    first = cut(rows.where("root is not null").groupBy("root").agg(F.min("id").alias("low")))
    out = rows.join(first, "root", "left").select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("low")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
