"""Findings of round three: disk of the vector blocks, CPU time of the anchors."""

from __future__ import annotations

import numpy as np

from plotline.llm import embedding_dedup as E
from plotline.llm import substring_dedup as S


def test_blocks_are_not_written_per_pair(spark, monkeypatch):
    """pairs of blocks are met by a product of partitions; nothing is exchanged between the meeting and the count."""
    plans = []

    def spy(df, fn, schema):
        if "nodes2" in df.columns:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, fn, schema)

    real = E.map_arrow
    monkeypatch.setattr(E, "map_arrow", spy)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(150, 8))
    rows = [(i, [float(x) for x in base[i % 150] + 0.05 * rng.normal(size=8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    out = {r.id: (r.n_links, r.component_id) for r in E.embedding_dedup(df, block=16).collect()}
    (plan,) = plans
    assert "CartesianProduct" in plan and "Exchange" not in plan[:plan.index("CartesianProduct")]
    x = np.array([v for _, v in rows], dtype=np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    low = np.arange(300)
    for _ in range(300):
        low = np.where(near, low, 300).min(axis=1)
    assert out == {i: (int(near[i].sum()) - 1, int(low[i])) for i in range(300)}


def test_anchors_are_the_first_smallest_spans():
    """The first scan needs no places; both ways give each window's first smallest span."""
    rng = np.random.default_rng(3)
    for window in (1, 2, 5, 13):
        for _ in range(30):
            words = [b"abc"[i:i + 1] for i in rng.integers(0, 3, rng.integers(window, 60))]
            text = b" ".join(words)
            half = S.half_length(window)
            spans = S.Spans(S.word_hashes(text), S._BASE)
            at = np.arange(len(words) - half + 1)
            a = spans.of(at, at + half).tolist()
            want = [min(range(i, i + window - half + 1), key=lambda j: (a[j], j)) for i in range(len(words) - window + 1)]
            _, n, place, h = S.anchors(spans, len(words), window)
            assert np.repeat(place, n).tolist() == want
            assert S.anchor_hashes(text, window).tolist() == sorted({a[j] for j in want}) == np.unique(h).tolist()
    assert S.anchor_hashes(b"a b", 13) is None
