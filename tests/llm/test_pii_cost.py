"""Matches of a text are placed without copying what was found before; those that are not kept cost no more than being read."""

import re
import time

from pyspark.sql import functions as F

from plotline.llm.pii import TERM, matches

WORD = re.compile(r"[^\W_]+")


def spans(t, kept):
    return [(m.start(), m.end(), m[0]) for m in WORD.finditer(t) if kept(m[0])]


def test_places_at_the_ends_of_blocks_and_parts(spark):
    sizes = (0, 1, 15, 16, 17, 31, 32, 33, 511, 512, 513, 528, 1024, 1025, 9000)
    texts = [("😀 " * (n % 2)) + " ".join(("é" * (i % 3) + f"w{i}", "stop", "Ab日")[i % 3] + "." * (i % 2) for i in range(n)) for n in sizes]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(4)
    every, some = matches(F.col("t"), TERM, "k"), matches(F.col("t"), TERM, "k", lambda v: v.startswith("A"))
    first = matches(F.col("t"), TERM, "k", lambda v: v == F.lit("w0"))
    none = matches(F.col("t"), TERM, "k", lambda v: F.lit(False))
    for r in df.select("t", every.alias("every"), some.alias("some"), first.alias("first"), none.alias("none")).collect():
        assert [(s.start, s.end, s.value) for s in r.every] == spans(r.t, lambda v: True) and {s.kind for s in r.every} <= {"k"}
        assert [(s.start, s.end, s.value) for s in r.some] == spans(r.t, lambda v: v[0] == "A")
        assert [(s.start, s.end, s.value) for s in r.first] == spans(r.t, lambda v: v == "w0")
        assert r.none == []


def test_placing_words_costs_in_proportion_to_finding_them(spark):
    text = " ".join(f"word{i}" for i in range(480))
    df = spark.range(0, 3000, 1, 4).select(F.concat(F.lit(text), F.lit(" "), "id").alias("t")).cache()
    assert df.count() == 3000

    def seconds(column):
        def once():
            begin = time.time()
            df.select(F.sum(F.size(column))).collect()
            return time.time() - begin
        return min(once() for _ in range(3))
    read = seconds(F.transform(F.regexp_extract_all("t", F.lit(TERM), F.lit(0)), F.lower))
    # about 9 times as long; 48 times where every word copies the ones before it
    assert seconds(matches(F.col("t"), TERM, "term")) < 24 * read
