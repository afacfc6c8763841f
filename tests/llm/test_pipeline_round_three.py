"""Every pipeline stage against brute force on that stage's own input; callers' columns with names used inside."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plotline.llm.exact_dedup import drop_exact_copies
from plotline.llm.pii import find_pii
from plotline.llm.quality import ACCEPT_AT, train_quality
from plotline.llm.simhash import drop_near_copies
from plotline.llm.tokens import byte_bpe
from tests.llm.test_operators import simhash, whole_document_terms

INSIDE = ["_th", "_len", "_prefix", "_cp", "_text_hash", "_risky", "_base", "_terms", "pii", "_row", "_id", "_n", "_text",
          "_keep_id", "_keep_th", "_quality_score", "id", "th", "n"]
RNG = np.random.default_rng(11)


def sentence(n):
    return " ".join(f"word{k}" for k in RNG.integers(0, 4000, n)) + "."


@pytest.fixture(scope="module")
def rows():
    good = [sentence(60) for _ in range(60)]
    bad = ["!!! $$$ >>> " * int(k) for k in RNG.integers(5, 40, 30)]
    near = [g + " tail" for g in good[:5]] + [" ".join(g.split()[:-1] + ["x"]) for g in good[5:9]]
    long = sentence(3000)
    texts = good + bad + near + [g.replace(" ", "  ") for g in good[:7]] + good[9:12] + [long, long + " end", None, "", " "]
    texts += [f"{sentence(20)} falcon {sentence(20)} amy@corp.example", f"falcon {sentence(30)} amy@corp.example {sentence(5)}", "call +1 (988) 555-2485 now " + sentence(30)]
    out = [(i, t) for i, t in enumerate(texts)]
    return out + [(None, good[20]), (None, sentence(40)), (3, good[3]), (3, good[3])]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.char_length("text")).repartition(3).write.parquet(f"{sf}/documents.parquet")
    labels = [(i, int("$$$" not in (t or ""))) for i, t in rows if i is not None] + [(None, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    return sf


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    """Input and output of every stage, as lists of rows."""
    base, docs, out = str(tmp_path_factory.mktemp("steps")), spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{base}/{name}")
        after = spark.read.parquet(f"{base}/{name}")
        out[name] = [docs.collect(), after.collect()]
        docs = after
    return out


def pairs(rs):
    return Counter((r.doc_id, r.text) for r in rs)


def test_quality_stage(spark, folder, steps):
    before, after = steps["quality_classifier"]
    model = train_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    scores = [model.score([(r.text or "").encode()])[0] for r in before]
    assert pairs(after) == pairs(r for r, s in zip(before, scores, strict=True) if s >= ACCEPT_AT)
    assert not any("$$$" in (r.text or "") for r in after) and sum(r.text is not None and r.text.startswith("word") for r in after) > 60


def test_exact_stage(steps):
    before, after = steps["exact_dedup"]
    groups = {}
    for r in before:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append(r)
    want = [min(g, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for g in groups.values()]
    assert Counter((r.doc_id, len(r.text or "")) for r in after) == Counter((r.doc_id, len(r.text or "")) for r in want)
    assert len(after) < len(before)


def test_near_stage(steps):
    before, after = steps["simhash_near_dedup"]
    fp = [simhash(r.text) for r in before]
    fp = [int(x, 16) if isinstance(x, str) else int(x) for x in fp]
    root = list(range(len(before)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fp)):
        for j in range(i):
            if ((fp[i] ^ fp[j]) & (2**64 - 1)).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(before):
        groups.setdefault(find(i), []).append(r)
    assert len(after) == len(groups) < len(before)
    for g in groups.values():
        best = min(((r.doc_id is None, r.doc_id or 0) for r in g))
        stays = [r for r in after if any((r.doc_id, r.text) == (x.doc_id, x.text) for x in g)]
        assert len(stays) == 1 and (stays[0].doc_id is None, stays[0].doc_id or 0) == best


def test_pii_stage(spark, steps):
    before, after = steps["pii"]
    marks = {"email": "[EMAIL]", "phone": "[PHONE]", "ip": "[IP]", "card": "[CARD]"}
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after)
    assert not any("amy@corp" in (r.text or "") or "555-2485" in (r.text or "") for r in after)
    assert any(marks["email"] in (r.text or "") for r in after) and any(marks["phone"] in (r.text or "") for r in after)
    bare = [(r.doc_id, r.text) for r in before]
    found = find_pii(spark.createDataFrame(bare, "doc_id long, text string"), confidence=0).collect()
    assert Counter((r.doc_id, r.text, tuple((s.start, s.end, s.value, s.action) for s in r.pii.terms)) for r in found) == Counter(whole_document_terms(bare))
    untouched = {r.text for r in before if not re.search(r"@|\+1|falcon", r.text or "")}
    kept = {r.text for r in after}
    assert len(untouched & kept) >= 0.95 * len(untouched)


def test_packing_stage(steps):
    before, after = steps["best_fit_packing"]
    tokenizer, want = byte_bpe(None).tokenizer, Counter()
    for r in before:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
        first, at = len(ids) % 1024 or 1024, 0
        for k, end in enumerate(range(first, len(ids) + 1, 1024)):
            want[(r.doc_id, k, at, end - at, zlib.crc32(np.array(ids[at:end], "<u4").tobytes()))] += 1
            at = end
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after) == want
    bins = {}
    for r in after:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_run(spark, folder, steps):
    def key(r):
        return r.doc_id, r.piece, r.start, r.length, r.ids_crc32
    assert Counter(map(key, corpus_pipeline.run(spark, folder).collect())) == Counter(map(key, steps["best_fit_packing"][1]))


def test_names_used_inside(spark):
    text = "some words amy@corp.example"
    df = spark.createDataFrame([(1, text, *range(len(INSIDE))), (2, text + " ", *range(len(INSIDE))), (None, None, *range(len(INSIDE)))],
                               "doc_id long, text string, " + ", ".join(f"{n} int" for n in INSIDE))
    for drop in (drop_exact_copies, drop_near_copies):
        out = sorted(drop(df).collect(), key=lambda r: r.doc_id or 99)
        assert [list(r[2:]) for r in out] == [list(range(len(INSIDE)))] * 2 and drop(df.limit(0)).count() == 0
        assert out[0].doc_id == (2 if drop is drop_exact_copies else 1)
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, df, "").columns == df.columns, name
