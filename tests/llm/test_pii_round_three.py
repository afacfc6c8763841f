"""PII in linear time, with a bound on weak evidence and any column names."""

import math
import re
import time

from pyspark.sql import functions as F

from plotline.llm.pii import find_pii, wilson_low


def test_many_matches_in_one_text(spark):
    rng = __import__("random").Random(5)
    words = [rng.choice(["plain", "é", "10.2.3.4", "x", "a.b@c.de", "+1 (988) 555-2485,", "300.1.1.1"]) + rng.choice(["", "y"]) for _ in range(5_000)]
    texts = [" ".join(words), " ".join(words[:63]), " ".join(words[:64]), " ".join(words[:65]), " ".join(words[:700])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    find_pii(df.limit(1)).collect()
    begin = time.time()
    for r in find_pii(df).collect():
        want = [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text)]
        assert [(s.start, s.end) for s in r.pii.base if s.kind == "email"] == want
        spans = sorted((s.start, s.end, s.kind) for s in r.pii.base)
        out, at = [], 0
        for a, b, kind in spans:
            if a >= at:
                out.append(r.text[at:a] + f"[{kind.upper()}]")
            at = max(at, b)
        assert r.pii.clean == "".join(out) + r.text[at:]
    assert time.time() - begin < 120


def test_weak_evidence_is_bounded(spark):
    low = spark.createDataFrame([(2, 2), (2, 21), (30, 30), (0, 5)], "k long, n long").select(wilson_low(F.col("k"), F.col("n"), 1.96)).collect()
    def wilson(k, n, z=1.96):
        p = k / n
        return (p + z * z / 2 / n - z * math.sqrt(p * (1 - p) / n + z * z / 4 / n / n)) / (1 + z * z / n)
    assert [round(r[0], 9) for r in low] == [round(wilson(*x), 9) for x in ((2, 2), (2, 21), (30, 30), (0, 5))]
    rows = [(i, f"strongword u{i} v{i} bob@corp.example w{i}") for i in range(30)]
    rows += [(100, "weakword one amy@corp.example"), (101, "two weakword three amy@corp.example")]
    rows += [(110 + i, f"weakword h{i}") for i in range(4)]
    rows += [(200 + i, f"filler f{i} g{i}") for i in range(3000)]
    out = {r.doc_id: r.pii for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all([s.value for s in out[i].terms] == ["strongword"] for i in range(30))
    assert out[100].terms == [] and out[100].clean == "weakword one [EMAIL]"


def test_clashing_names(spark):
    names = ["_th", "_risky", "_base", "_terms", "_row", "_id", "_text", "_term_id", "t", "base", "th", "pii"]
    df = spark.createDataFrame([(1, "a@b.co x", *range(len(names))), (None, None, *range(len(names)))],
                               "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = find_pii(df).orderBy(F.col("doc_id").isNull()).collect()
    assert [[r[n] for n in names[:-1]] for r in out] == [list(range(len(names) - 1))] * 2
    assert out[0].pii.clean == "[EMAIL] x" and out[1].pii.clean is None and out[0].pii.base[0].value == "a@b.co"
