"""Substring dedup: repeated word windows found level by level, the length doubling."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_arrow, text_of

WINDOW = 13
#: bits of the filter sent to the tasks of the second scan (16 MB, whatever the input)
FILTER_BITS = 1 << 27
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE2 = np.uint64(0xC2B2AE3D27D4EB4F)
_LAST_ID = (1 << 63) - 1
#: windows that a task gathers before it passes them on
_EMIT = 1 << 18


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, made once per process and grown on demand."""

    def __init__(self, base: np.uint64):
        self.factors = base, np.uint64(pow(int(base), -1, 1 << 64))
        self.tables = [np.ones(1, dtype=np.uint64)] * 2

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers 0 to ``n`` of base and inverse."""
        if len(self.tables[0]) <= n:
            size = max(n + 1, 1 << 12)
            self.tables = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size, f))), dtype=np.uint64) for f in self.factors]
        return self.tables[0][:n + 1], self.tables[1][:n + 1]


_POWERS = {int(b): _Powers(b) for b in (_BASE, _BASE2)}
#: a fixed random number for each byte; white space counts nothing
_BYTES = np.random.default_rng(13).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACES = np.zeros(256, dtype=bool)
_SPACES[[9, 10, 11, 12, 13, 32]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: bytes of text hashed at a time
_PART = 1 << 20


def _part_hashes(text: bytes) -> np.ndarray:
    """Hashes of the words of a piece of text that is cut at white space."""
    b = np.frombuffer(text, np.uint8)
    space = _SPACES[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    start, stop = edge[::2], edge[1::2]
    power, back = _POWERS[int(_BASE)].upto(len(b))
    sums = np.zeros(len(b) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[b] * power[:-1], dtype=np.uint64, out=sums[1:])
    return _mixed((sums[stop] - sums[start]) * back[start] + (stop - start).astype(np.uint64))


def _long_word_hash(word: bytes) -> np.ndarray:
    """The hash ``_part_hashes`` gives a word, without arrays of the word's length."""
    total, scale, base = 0, 1, int(_BASE)
    for at in range(0, len(word), _PART):
        piece = np.frombuffer(word[at:at + _PART], np.uint8)
        power, _ = _POWERS[base].upto(len(piece))
        total += scale * int((_BYTES[piece] * power[:-1]).sum(dtype=np.uint64))
        scale = scale * pow(base, len(piece), 1 << 64) % (1 << 64)
    return _mixed(np.array([(total + len(word)) % (1 << 64)], dtype=np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, piece by piece whatever its length."""
    out, at = [], 0
    while at < len(text):
        end = at + _PART
        if end < len(text):
            found = _SPACE.search(text, end)
            end = found.end() if found else len(text)
        piece = text[at:end]
        # a piece far over its size ends in one very long word
        if len(piece) > 4 * _PART:
            first = max((piece.rfind(bytes([c]), 0, _PART) for c in (9, 10, 11, 12, 13, 32))) + 1
            head = piece[:first]
            out += [_part_hashes(head)] if head else []
            out += [_long_word_hash(w) for w in piece[first:].split()]
        else:
            out.append(_part_hashes(piece))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


class Spans:
    """Hashes of word spans: any span in one step after a pass over the text."""

    def __init__(self, h: np.ndarray, base: np.uint64):
        power, self.back = _POWERS[int(base)].upto(len(h))
        self.sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * power[:-1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def half_length(window: int) -> int:
    """Length at the first level: its double reaches the window."""
    return -(-window // 2)


def _least(spans: Spans, n: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the half-length spans, and the smallest of them in each window."""
    half = half_length(window)
    at = np.arange(n - half + 1)
    a = spans.of(at, at + half)
    n_win = n - window + 1
    best = a[:n_win].copy()
    for j in range(1, window - half + 1):
        np.minimum(best, a[j:j + n_win], out=best)
    return a, best


def anchor_hashes(text: bytes, window: int) -> np.ndarray | None:
    """The different anchors of a text, without their places."""
    h = word_hashes(text)
    if len(h) < window:
        return None
    _, best = _least(Spans(h, _BASE), len(h), window)
    return np.unique(best[np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))])


def anchors(spans: Spans, n: int, window: int) -> tuple[np.ndarray, ...]:
    """Runs of consecutive windows sharing an anchor: first window, number of windows, anchor's place and hash.

    A window's anchor is the half-length span in it with the smallest hash (the
    first of equals), so equal windows have equal anchors at the same place.
    """
    a, best = _least(spans, n, window)
    n_win = len(best)
    arg = np.zeros(n_win, dtype=np.int64)
    for j in range(window - half_length(window), 0, -1):
        np.copyto(arg, j, where=a[j:j + n_win] == best)
    np.copyto(arg, 0, where=a[:n_win] == best)
    arg += np.arange(n_win)
    q = np.flatnonzero(np.concatenate(([True], arg[1:] != arg[:-1])))
    return q, np.diff(np.append(q, n_win)), arg[q], a[arg[q]]


def _runs_of(text: bytes, window: int) -> tuple | None:
    h = word_hashes(text)
    if len(h) < window:
        return None
    spans = Spans(h, _BASE)
    return h, spans, *anchors(spans, len(h), window)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                    with_text: bool = False) -> DataFrame:
    """One row per input row: ``id, n_words, n_removed, kept_sha256[, kept_text]``.

    Each word covered by a window of ``window`` words whose word sequence also
    starts in a document with a smaller id is removed; windows are judged on the
    input.  Words are runs free of ASCII white space, kept words are joined by
    one space, null text has no words, fewer words than a window are all kept.

    Level 1 looks at spans of half the window, not at all of them but at each
    window's anchor (see ``anchors``), about one span in four words; a map-side
    aggregated count keeps the anchors met under two ids.  Level 2 doubles the
    length: around surviving anchors only, whole runs of windows are compared
    (most repeats are long), and where one anchor has several different runs, their
    windows one by one.  No candidates, no further level.  Positions travel, and
    the text, compressed, once per level to meet them.  The second scan drops
    anchors missing from a fixed-size filter of the repeated ones before they are
    joined: past about 10^8 repeated anchors it fills up and only saves less.
    Hot anchors are aggregated map-side, and joined with an exchange on both sides.

    Ids are integers; a null id counts as larger than any other.  Rows with the
    same id never make each other's words go; they are told apart by a hash of the
    text.  An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST_ID)).alias("key"),
                      F.xxhash64(text_of(text_col)).alias("th"), F.encode(text_of(text_col), "UTF-8").alias("t"))

    # level 1: anchors met under two ids
    def emit_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, out, of = b.column(0).to_numpy(zero_copy_only=False), [], []
            for i, t in enumerate(b.column(1)):
                own = anchor_hashes(t.as_py(), window)
                if own is not None:
                    out.append(own)
                    of.append(np.full(len(own), keys[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)),
                                                  pa.array(np.concatenate(of))], names=["a", "key"])

    met = map_arrow(src.select("key", "t"), emit_anchors, "a long, key long")
    shared = cut(met.groupBy("a").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi").select("a"))

    # each bucket of bits in one place before its bitmap is made: partial bitmaps would be 16 MB a task
    bit = F.pmod("a", F.lit(FILTER_BITS))
    bucketed = shared.select((bit / 32768).cast("int").alias("bucket"), (bit % 32768).cast("int").alias("bit")).repartition("bucket")
    rows = bucketed.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits")).collect()      # 4096 rows at most
    bits = np.zeros((FILTER_BITS // 32768, 4096), dtype=np.uint8)
    for r in rows:
        bits[r.bucket] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    sent = spark.sparkContext.broadcast(bits.reshape(-1))

    def emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sent.value
        for b in batches:
            keys, ths = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cols: list[list[np.ndarray]] = [[], [], [], []]
            for i, t in enumerate(b.column(2)):
                r = _runs_of(t.as_py(), window)
                if r is None:
                    continue
                place, a = r[4], r[5]
                x = (a.view(np.int64) % FILTER_BITS).astype(np.int64)
                own = held[x >> 3] >> (x & 7).astype(np.uint8) & 1 > 0
                for c, v in zip(cols, (a[own].view(np.int64), np.full(own.sum(), keys[i]),
                                       np.full(own.sum(), ths[i]), place[own].astype(np.int32))):
                    c.append(v)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols],
                                                 names=["a", "key", "th", "place"])

    places = map_arrow(src.select("key", "th", "t"), emit_places, "a long, key long, th long, place int")
    per_doc = (places.join(shared, "a", "left_semi").groupBy("key", "th")
               .agg(F.collect_set("place").alias("places")))

    # the text travels compressed
    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            packed = pa.array([z.compress(t.as_py()) for t in b.column(b.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], packed], names=[*b.schema.names[:-1], "z"])

    id_type = docs.schema[id_col].dataType.simpleString()
    small = map_arrow(src, compress, f"id {id_type}, key long, th long, z binary")

    # level 2: runs of windows around surviving anchors
    names = ["a", "c1", "c2", "key", "th", "q", "n", "windows"]

    def run_batch(cols: list[list]) -> pa.RecordBatch:
        sizes = np.concatenate([n for n, _ in cols[7]])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)),
                                         pa.array(np.concatenate([v for _, v in cols[7]])))
        return pa.RecordBatch.from_arrays([*[pa.array(np.concatenate(c)) for c in cols[:7]], lists], names=names)

    def emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[] for _ in names]
            held = 0
            for key, th, packed, own in zip(*(b.column(i) for i in range(4)), strict=True):
                h, spans, q, n, place, a = _runs_of(z.decompress(packed.as_py()), window)
                pick = np.isin(place, np.array(own.as_py(), dtype=np.int64))
                q, n, place, a = q[pick], n[pick], place[pick], a[pick]
                stop = q + n + window - 1
                shape = (n.astype(np.uint64) << np.uint64(32)) + (place - q).astype(np.uint64)
                c1, c2 = (_mixed(s.of(q, stop) + shape) for s in (spans, Spans(h, _BASE2)))
                w = Spans(h, _BASE2)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(q, n)
                whole = w.of(at, at + window).view(np.int64)
                for c, v in zip(cols, (a.view(np.int64), c1.view(np.int64), c2.view(np.int64),
                                       np.full(len(q), key.as_py()), np.full(len(q), th.as_py()),
                                       q.astype(np.int32), n.astype(np.int32)), strict=False):
                    c.append(v)
                cols[7].append((n, whole))
                held += len(whole)
                if held > _EMIT:
                    yield run_batch(cols)
                    cols, held = [[] for _ in names], 0
            if cols[0]:
                yield run_batch(cols)

    near = small.select("key", "th", "z").join(per_doc, ["key", "th"])
    runs = cut(map_arrow(near.select("key", "th", "z", "places"), emit_runs,
                         "a long, c1 long, c2 long, key long, th long, q int, n int, windows array<long>"))
    kinds = cut(runs.groupBy("c1", "c2").agg(F.min("key").alias("lo"), F.max("key").alias("hi"),
                                             F.min("a").alias("a")))
    whole = (runs.select("c1", "c2", "key", "th", "q", "n").join(kinds.where("lo < hi").select("c1", "c2", "lo"),
                                                                 ["c1", "c2"])
             .where("key > lo").select("key", "th", "q", "n"))
    # an anchor with several kinds of runs: the first of each kind, window by window
    mixed = cut(kinds.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a"))
    first = (runs.join(mixed, "a", "left_semi").join(kinds.select("c1", "c2", "lo"), ["c1", "c2"])
             .where("key = lo").select("a", "key", "th", "q", F.posexplode("windows").alias("o", "w")))
    single = cut(first)
    lows = cut(single.groupBy("a", "w").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo < hi")
               .select("a", "w", "lo"))
    one = (single.join(lows, ["a", "w"]).where("key > lo")
           .select("key", "th", (F.col("q") + F.col("o")).alias("q"), F.lit(1).alias("n")))
    found = (whole.unionByName(one).groupBy("key", "th")
             .agg(F.collect_list(F.struct("q", "n")).alias("found")))

    fields = f"id {id_type}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for packed, own in zip(b.column(1), b.column(2), strict=True):
                words = z.decompress(packed.as_py()).split()
                kept = words
                if own.is_valid:
                    pairs = np.array([(x["q"], x["n"]) for x in own.as_py()], dtype=np.int64)
                    edge = np.zeros(len(words) + 1, dtype=np.int64)
                    np.add.at(edge, pairs[:, 0], 1)
                    np.add.at(edge, pairs[:, 0] + pairs[:, 1] + window - 1, -1)
                    gone = np.cumsum(edge)[:-1] > 0
                    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                text = b" ".join(kept)
                for c, v in zip(cols, (len(words), len(words) - len(kept), hashlib.sha256(text).hexdigest(),
                                       text.decode()), strict=True):
                    c.append(v)
            out = [b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                   pa.array(cols[2], pa.string())] + [pa.array(cols[3], pa.string())] * with_text
            names = ["id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text
            yield pa.RecordBatch.from_arrays(out, names=names)

    last = small.join(found, ["key", "th"], "left").select("id", "z", "found")
    return map_arrow(last, remove, fields)
