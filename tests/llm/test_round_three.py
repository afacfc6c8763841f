"""Hard negatives, language identification and fill-in-middle against brute force."""

import hashlib
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plotline.llm import queries as Q
from plotline.llm.fill_in_middle import fill_in_middle, output_digest, read_output
from plotline.llm.hard_negatives import Anchors, encode, hard_negatives, unit_rows
from plotline.llm.language import ByteModel, identify_language, train_language

RNG = np.random.default_rng(5)


# --- hard negatives ---------------------------------------------------------------------------

def mined(rows, positives, negatives):
    """(anchor, positive, rank, negative, positive score, negative score) by brute force."""
    rows = {(i, label, tuple(math.floor(256 * x) for x in e)) for i, label, e in rows
            if i is not None and label is not None and e and all(x is not None and math.isfinite(x) and abs(256 * x) < 1 << 22 for x in e)}
    out = []
    for i, label, q in rows:
        if i % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), j, m == label) for j, m, r in rows if j != i and len(r) == len(q)]
        for ps, p, _ in sorted(x for x in scored if x[2])[:positives]:
            fit = sorted(x for x in scored if not x[2] and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:negatives]
            out += [(i, p, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(fit)]
    return Counter(out)


@pytest.mark.parametrize("dim", [64, 20, 130])
def test_hard_negatives(spark, dim):
    base = RNG.normal(size=(6, dim)) / dim ** 0.5
    rows = [(i, int(RNG.integers(0, 4)), [float(x) for x in base[i % 6] + 0.08 * RNG.normal(size=dim)]) for i in range(700)]
    rows += [(1000 + k, k % 3, rows[5][2]) for k in range(60)]                      # one common vector: ties
    rows += [(1100, 1, [0.0] * dim), (1200, 1, [-x for x in rows[100][2]]), (1300, 9, rows[3][2])]
    rows += [(1400, None, rows[3][2]), (1500, 1, None), (1600, 1, [float("nan")] * dim), (1700, 1, [1.0, None]), (1800, 1, []),
             (None, 1, rows[3][2]), (1900, 1, [1e9] * dim), (2000, 1, [1.0, 2.0]), (2001, 1, [1.0, 2.0]), (2002, 2, [0.5, 0.25])]
    rows += [rows[100], rows[100], rows[7], (200, 3, rows[7][2])]                   # repeated rows; an id with two vectors
    df = spark.createDataFrame([(i, label, e, 1, 2) for i, label, e in rows],
                               "vec_id long, label int, embedding array<double>, key int, q int").repartition(5)
    got = Counter(tuple(r) for r in hard_negatives(df, F.col("id") % 100 == 0).collect())
    assert got == mined(rows, 5, 10)
    if dim == 20:
        assert hard_negatives(df.limit(0), F.col("id") % 100 == 0).count() == 0
        few = hard_negatives(df, F.col("id") == 300, positives=2, negatives=3, levels=1)
        want = mined(rows, 2, 3)
        assert Counter(tuple(r) for r in few.collect()) == Counter({k: n for k, n in want.items() if k[0] == 300})


def test_intervals_hold_every_score_and_shrink_by_level():
    q = RNG.integers(-300, 300, (400, 48))
    q[7] = 0
    anchors = RNG.integers(-300, 300, (9, 48))
    anchors[3] = 0
    exact = anchors @ q.T
    widths = []
    for levels in (1, 3, 6):
        lower, upper = Anchors(anchors, levels).intervals(np.arange(9), *encode(q, levels))
        assert (lower <= exact).all() and (exact <= upper).all()
        widths.append(np.median((upper - lower)[0] / (unit_rows(anchors)[1][0] * unit_rows(q)[1] + 1e-9)))
    assert widths[0] > 2 * widths[1] > 4 * widths[2]


# --- language ---------------------------------------------------------------------------------

def tree(texts, order, least):
    """Counts by context, pruned as the model prunes them, from (lang, bytes) pairs."""
    every = {}
    for t in texts:
        low = b"\0" * order + t.lower() if t.isascii() else b"\0" * order + bytes(b + 32 if 65 <= b <= 90 else b for b in t)
        for i in range(order, len(low)):
            for k in range(order + 1):
                every.setdefault((k, low[i - k:i]), Counter())[low[i]] += 1
    n = sum(len(t) for t in texts)
    return {c: (sum(x.values()), len(x), {s: m for s, m in x.items() if m >= least * n}) for c, x in every.items()}


def code_length(t, order, counts):
    low = b"\0" * order + bytes(b + 32 if 65 <= b <= 90 else b for b in t)
    bits = 0.0
    for i in range(order, len(low)):
        ruled_out, done = set(), False
        for k in range(order, -1, -1):
            total, kinds, own = counts.get((k, low[i - k:i]), (0, 0, {}))
            if not own:
                continue
            escape = kinds + total - sum(own.values())
            rest = {s: n for s, n in own.items() if s not in ruled_out}
            whole = sum(rest.values()) + escape
            if low[i] in own:
                bits -= math.log2(own[low[i]] / whole)
                done = True
                break
            bits -= math.log2(escape / whole)
            ruled_out |= set(own)
        if not done:
            bits += math.log2(256 - len(ruled_out))
    return bits


ENGLISH = ["The cat sat on the mat", "and THEN the dog ran", "there is the other hat", "a" * 300, ""]
GERMAN = ["Der Hund läuft über die Straße", "und dann der große Käse", "die Katze saß auf der Matte"]
SCHEMA = "doc_id long, text string, lang string, id string, bits int, score int"


def language_rows():
    rows = [(i, t, "en") for i, t in enumerate(ENGLISH)] + [(20 + i, t, "de") for i, t in enumerate(GERMAN)]
    rows += [(40, None, "en"), (41, "no label here", None), (None, GERMAN[0], "de"), (42, "12 -- 34!", "de"), (43, " ".join(ENGLISH * 40), None),
             (0, ENGLISH[0], "en"), (44, "日本", None), (45, "x\x00y", None)]
    return rows


@pytest.mark.parametrize("least", [2.0 ** -18, 0.02])
def test_language_code_lengths(spark, least):
    rows = language_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    model = train_language(df, leaf_share=least)
    assert model.langs == ["de", "en"]
    counts = {x: tree([(t or "").encode() for _, t, lang in rows if lang == x], 3, least) for x in model.langs}
    out = identify_language(df, model).collect()
    got = Counter((r.id, r.lang_pred, tuple(round(x, 6) for x in r.bits)) for r in out)
    want = Counter()
    for i, t, _ in rows:
        bits = [code_length((t or "").encode(), 3, counts[x]) for x in model.langs]
        pred = min(zip(bits, model.langs))[1] if any(c.isalpha() for c in t or "") else "und"
        want[(i, pred, tuple(round(x, 6) for x in bits))] += 1
    assert got == want
    assert all(0 <= r.score <= 1 and (r.score == 0) == (r.lang_pred == "und") for r in out)
    assert all(abs(r.score - 1 / sum(2 ** (min(r.bits) - x) for x in r.bits)) < 1e-9 for r in out if r.lang_pred != "und")
    # the 256 next bytes share probability one after any context
    after = np.array([[(c << 8) | s for s in range(256)] for c in (0, int.from_bytes(b"the", "big"), int.from_bytes(b"zz ", "big"))], np.uint32)
    for row in after:
        assert np.allclose(np.exp2(-model.bits(row)).sum(0), 1)


def test_language_without_training_rows(spark):
    df = spark.createDataFrame([(1, "words", None), (2, None, None)], "doc_id long, text string, lang string")
    model = train_language(df)
    assert isinstance(model, ByteModel) and model.langs == []
    assert {(r.id, r.lang_pred, r.score) for r in identify_language(df, model).collect()} == {(1, "und", 0.0), (2, "und", 0.0)}
    assert identify_language(df.limit(0), model).count() == 0 and train_language(df.limit(0)).langs == []


def test_long_texts_cross_chunks(spark, monkeypatch):
    from plotline.llm import language
    import pyarrow as pa
    texts = [b"", b"ab", b"", b"cdefgh" * 5, b"X", b""]
    whole = [np.concatenate(x) for x in zip(*language.grams(pa.array(texts, pa.binary())))]
    monkeypatch.setattr(language, "_CHUNK", 4)
    parts = [np.concatenate(x) for x in zip(*language.grams(pa.array([b"zz", *texts], pa.binary())[1:]))]
    assert all((a == b).all() for a, b in zip(whole, parts)) and len(whole[0]) == sum(map(len, texts))


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.QUERIES["op12_language"](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    seen = out.join(docs, "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    assert seen.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
    assert out.count() == docs.count()


# --- fill in middle ---------------------------------------------------------------------------

def cut_text(i, t):
    t = t or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    n = len(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    p, m, s = t[:a], t[a:b], t[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("frame_bytes", [7, 1 << 16])
def test_fill_in_middle(spark, frame_bytes):
    odd = ["", None, "a", "é", "日本語 text", "has <P> inside", "<M>", "<<S", "S><", "á 😀😀", "<P", "x" * 300, "Ünï 😀 <S <M P> " * 60, "\n\t "]
    rows = [(i, odd[i % len(odd)]) for i in range(150)] + [(3, "twice"), (3, "twice"), (None, "no id"), (None, None)]
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id long, text string, form string, n int, frames string").repartition(3)
    fim = fill_in_middle(df, frame_bytes=frame_bytes)
    want = [(i, t or "", cut_text(i, t)) for i, t in rows]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()      # noqa: E731
    assert Counter(tuple(r) for r in output_digest(fim).collect()) == Counter((i, *w[:4], sha(w[4]), sha(t)) for i, t, w in want)
    assert Counter(tuple(r) for r in read_output(fim).collect()) == Counter((i, w[4]) for i, _, w in want)
    assert Counter(tuple(r) for r in read_output(fim, restore=True).collect()) == Counter((i, t) for i, t, _ in want)
    assert {w[1] for _, _, w in want} == {"plain", "psm", "spm"}
    assert output_digest(fill_in_middle(df.limit(0))).count() == 0


def test_selection_opens_only_the_cut_frames():
    import zstandard
    from plotline.llm.fill_in_middle import span, to_frames
    c, d = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
    text = "".join(chr(0x61 + i % 26) if i % 5 else "é" for i in range(5000))
    frames = to_frames(text.encode(), 100, c)

    class Counting:
        opened = 0

        def decompress(self, z):
            self.opened += 1
            return d.decompress(z)
    for lo, hi in ((0, 5000), (3, 4), (10, 4321), (700, 700), (4999, 5000)):
        opener = Counting()
        got = list(span(frames, lo, hi, c, opener))
        assert b"".join(d.decompress(z) for _, z in got).decode() == text[lo:hi] and sum(n for n, _ in got) == hi - lo
        assert opener.opened <= 2


