"""SimHash near-dedup with Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_arrow, text_of
from .components import connected_components

#: fixed value: generator polynomial of the (23, 12) Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1
GOLAY_GENERATOR = 0xC75
#: how the 64 bits are dealt to three code words of at most 23 bits (low bits first)
SEGMENT_BITS = (22, 21, 21)


# -- fingerprints -----------------------------------------------------------

def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text (A-Z lower-cased, words by ASCII white space)."""
    words = text.lower().split()            # bytes: only A-Z and ASCII white space are meant
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    k = min(shingle, len(words))
    stops = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(stops)
    for at in range(0, n, 65536):           # bounded memory for very long texts
        h = np.fromiter((digest(joined[a:b], seed) for a, b in
                         zip(starts[at:min(at + 65536, n)], stops[at:at + 65536], strict=True)), dtype="<u8")
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """``(id, fp, th)`` per row: SimHash as a signed long and a hash of the text."""
    src = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    src = src.select("id", F.xxhash64("t").alias("th"), F.encode("t", "UTF-8").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = pa.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, b.column(1)], names=["id", "fp", "th"])

    return map_arrow(src, run, f"id {id_type}, fp long, th long")


# -- Golay code -------------------------------------------------------------

def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY_GENERATOR << (bit - 11)
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of each byte of a word, and the error pattern (weight <= 3) of each syndrome."""
    unit = [_remainder(1 << i) for i in range(23)]
    syn = np.zeros((3, 256), dtype=np.int64)
    for byte in range(3):
        for value in range(256):
            for i in range(8):
                if value >> i & 1 and 8 * byte + i < 23:
                    syn[byte, value] ^= unit[8 * byte + i]
    error = np.zeros(2048, dtype=np.int64)
    for i in range(23):
        error[unit[i]] = 1 << i
        for j in range(i):
            error[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                error[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return syn, error


def golay_index(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the one code word within three bits of each 23-bit word."""
    syn, error = _tables()
    s = syn[0][words & 255] ^ syn[1][words >> 8 & 255] ^ syn[2][words >> 16]
    return (words ^ error[s]) >> 11


def golay_keys(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(variants, keys)``: the words at most ``radius`` (0 or 1) bits from each
    fingerprint, and the 36-bit key made of the three segments' code word indices."""
    u = fps.astype(np.uint64)[:, None]
    flips = np.concatenate(([0], np.uint64(1) << np.arange(64, dtype=np.uint64))).astype(np.uint64)
    z = u ^ flips[: 65 if radius else 1][None, :]
    keys, shift = np.zeros(z.shape, dtype=np.int64), 0
    for bits in SEGMENT_BITS:
        seg = (z >> np.uint64(shift) & np.uint64((1 << bits) - 1)).astype(np.int64)
        keys = keys << 12 | golay_index(seg)
        shift += bits
    return z.view(np.int64), keys


# -- links ------------------------------------------------------------------

def simhash_links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """``(a, b)`` links that join all fingerprints (column ``fp``, distinct) at most ``max_bits`` apart.

    Two words at most two bits apart have a word z at most one bit from both, and
    z lies one bit off in one segment at most (the pigeonhole).  So each
    fingerprint takes as keys the Golay indices of its segments, with one segment
    at a time replaced by the indices of its one-bit neighbours: at most 16 keys.
    Keys held by one fingerprint alone are dropped after a map-side count.  For
    the rest the candidates are verified by the words z themselves: fingerprints
    meeting in the same z (65 at most, whatever the size of the key's group) are
    within two bits, which is checked again bit by bit, and are linked to the
    smallest of them.  No pairs of a group are listed.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    radius = 1 if max_bits else 0

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 8192):
                part = fp[at:at + 8192]
                keys = np.sort(golay_keys(part, radius)[1], axis=1)
                first = np.concatenate((np.ones((len(part), 1), bool), keys[:, 1:] != keys[:, :-1]), axis=1)
                rows = np.broadcast_to(part[:, None], keys.shape)
                yield pa.RecordBatch.from_arrays([pa.array(keys[first]), pa.array(rows[first])], names=["key", "fp"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for at in range(0, len(fp), 8192):
                part = fp[at:at + 8192]
                z, keys = golay_keys(part, radius)
                own = keys == key[at:at + 8192, None]
                rows = np.broadcast_to(part[:, None], z.shape)
                yield pa.RecordBatch.from_arrays([pa.array(z[own]), pa.array(rows[own])], names=["z", "fp"])

    keyed = cut(map_arrow(fps.select("fp"), keys_of, "key long, fp long"))
    shared = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    met = map_arrow(keyed.join(shared, "key").select("key", "fp"), meet, "z long, fp long")
    group = met.groupBy("z").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)
    star = group.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return star.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits).distinct()


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                  max_bits: int = 2) -> DataFrame:
    """One row per input row: ``id, th, fp, fingerprint, component_id, kept``.

    ``fingerprint`` is 16 hex digits; ``component_id`` the smallest id reachable
    over links of at most ``max_bits`` (0 to 2) differing bits, the row's own
    included (null ids are ignored; null when the component has no other).
    ``th`` is a hash of the text.  ``kept`` marks the rows that stay: the
    component's smallest (id, text hash), null ids last; repeated rows alike in
    both are all marked, being one row to this operator.

    Null and empty texts have fingerprint zero, linked like any other.  Rows
    are folded to distinct fingerprints before any candidate search, so a text
    held by a third of all rows is one fingerprint.  An empty table gives an empty
    result; other columns are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, shingle))
    links = simhash_links(rows.select("fp").distinct(), max_bits)
    comp = cut(connected_components(links))
    rooted = cut(rows.join(comp, rows.fp == comp.node, "left")
                 .select("id", "th", "fp", F.coalesce("component", "fp").alias("root")))
    first = cut(rooted.groupBy("root").agg(
        F.min("id").alias("component_id"),
        F.min(F.struct(F.col("id").isNull().alias("z"), "id", "th")).alias("best")))
    return rooted.join(first, "root").select(
        "id", "th", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
        (F.col("best.id").eqNullSafe(F.col("id")) & (F.col("best.th") == F.col("th"))).alias("kept"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                     max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` that stay, one per component, with the columns of ``docs``, whatever their names.

    Null and empty texts are one component; of rows alike in id and text one is
    taken.  An empty table gives an empty result.
    """
    kept = cut(simhash_dedup(docs, id_col, text_col, shingle, max_bits).where("kept")
               .select(F.col("id").alias("_keep_id"), F.col("th").alias("_keep_th")).distinct())
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_th"))
    match = F.col("_id").eqNullSafe(F.col("_keep_id")) & (F.col("_th") == F.col("_keep_th"))
    found = tagged.join(kept, match, "left_semi").dropDuplicates(["_id", "_th"])
    return found.select(*[F.col("_row")[c].alias(c) for c in docs.columns])
