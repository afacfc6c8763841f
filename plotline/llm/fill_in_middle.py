"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames with cumulative unit counts
(a unit is a code point).  Selecting a span decompresses only the frames its
ends fall into; every other frame is passed on as it is.  Digests stream the
frames in order, so no step holds more than one decompressed frame of a text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import map_arrow, text_of

#: bytes of text in a frame
FRAME_BYTES = 1 << 16
MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: order of the sections in the output of each form
ORDERS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
_FRAMES = "frames array<struct<units: long, z: binary>>"

Frame = tuple[int, bytes]           # (units from the beginning to the end of the frame, compressed bytes)


def units_in(raw: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))


def byte_of_unit(raw: bytes, unit: int) -> int:
    """Place of the first byte of a unit (the length for the one after the last)."""
    starts = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
    return int(starts[unit]) if unit < len(starts) else len(raw)


def to_frames(raw: bytes, size: int, z: zstandard.ZstdCompressor) -> list[Frame]:
    """Frames of about ``size`` bytes each, cut between code points; no bytes, no frames."""
    out, at, units = [], 0, 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        units += units_in(raw[at:end])
        out.append((units, z.compress(raw[at:end])))
        at = end
    return out


def span(frames: list[Frame], lo: int, hi: int, c: zstandard.ZstdCompressor,
         d: zstandard.ZstdDecompressor) -> Iterator[tuple[int, bytes]]:
    """Frames (own units, compressed) of the units ``lo`` to ``hi``; only those holding an end are opened."""
    ends = [u for u, _ in frames]
    for k in range(int(np.searchsorted(ends, lo, "right")), len(frames)):
        begin = ends[k - 1] if k else 0
        if begin >= hi:
            return
        if lo <= begin and ends[k] <= hi:
            yield ends[k] - begin, frames[k][1]
        else:
            raw = d.decompress(frames[k][1])
            a, b = max(lo, begin) - begin, min(hi, ends[k]) - begin
            yield b - a, c.compress(raw[byte_of_unit(raw, a):byte_of_unit(raw, b)])


def find_marks(pieces: Iterable[bytes]) -> dict[bytes, int]:
    """First place (in bytes) of each mark in a text that arrives in pieces."""
    found: dict[bytes, int] = {}
    at, tail = 0, b""
    for p in pieces:
        held = tail + p
        for m in MARKS.values():
            if m not in found and (k := held.find(m)) >= 0:
                found[m] = at - len(tail) + k
        at += len(p)
        tail = held[-2:]
    return found


def restored(frames: list[Frame], form: str, d: zstandard.ZstdDecompressor) -> Iterator[bytes]:
    """The original text, piece by piece, from the frames of an output and its form."""
    if form == "plain":
        yield from (d.decompress(z) for _, z in frames)
        return
    found = find_marks(d.decompress(z) for _, z in frames)
    order = ORDERS[form]
    begins = {s: found[MARKS[s]] for s in order}
    ends = {s: begins[t] for s, t in zip(order, order[1:])}
    for section in ("prefix", "middle", "suffix"):
        lo, hi = begins[section] + len(MARKS[section]), ends.get(section)
        at = 0
        for _, z in frames:
            size = zstandard.frame_content_size(z)
            if at + size > lo and (hi is None or at < hi):
                yield d.decompress(z)[max(0, lo - at):size if hi is None else max(0, hi - at)]
            at += size


def store_frames(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """``id, n, marked, frames``: every text as compressed frames, its units, and whether it holds a mark.

    One row per input row; null text is empty and has no frames.  Other columns
    are not read.  An empty table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    t = text_of(text_col)
    marked = t.contains("<P>") | t.contains("<S>") | t.contains("<M>")
    src = docs.select(F.col(id_col).alias("id"), marked.alias("marked"), F.encode(t, "UTF-8").alias("t"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            rows = [to_frames(t.as_buffer().to_pybytes(), frame_bytes, z) for t in b.column(2)]
            n = pa.array([r[-1][0] if r else 0 for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, b.column(1), _frame_array(rows)],
                                             names=["id", "n", "marked", "frames"])

    return map_arrow(src, store, f"id {id_type}, n long, marked boolean, {_FRAMES}")


def _frame_array(rows: list[list[Frame]]) -> pa.Array:
    offsets = np.cumsum([0] + [len(r) for r in rows]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array([u for r in rows for u, _ in r], pa.int64()),
                                         pa.array([z for r in rows for _, z in r], pa.binary())], names=["units", "z"])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def _frames_of(cell: pa.Scalar) -> list[Frame]:
    return [(x["units"], x["z"]) for x in cell.as_py()]


def choose_cuts(stored: DataFrame, plain_percent: int = 10, spm_percent: int = 20, seed: str = "1:") -> DataFrame:
    """Adds ``form``, ``prefix_chars`` and ``middle_chars`` (null if plain), drawn from a hash of the id.

    A null id counts as empty text, so its rows are all cut by the same numbers.
    """
    h = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)

    def draw(i: int) -> Column:
        return F.conv(F.substring(h, 8 * i - 7, 8), 16, 10).cast("long")

    a, b = draw(1) % (F.col("n") + 1), draw(2) % (F.col("n") + 1)
    plain = (F.col("n") == 0) | F.col("marked") | (draw(3) % 100 >= 100 - plain_percent)
    form = F.when(plain, "plain").when(draw(4) % 100 < spm_percent, "spm").otherwise("psm")
    return (stored.withColumns({"form": form, "a": F.least(a, b), "b": F.greatest(a, b)})
            .withColumns({"prefix_chars": F.when(F.col("form") != "plain", F.col("a")),
                          "middle_chars": F.when(F.col("form") != "plain", F.col("b") - F.col("a"))})
            .select("id", "n", "form", "prefix_chars", "middle_chars", "frames"))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10,
                   spm_percent: int = 20, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """One row per input row: ``id, n, form, prefix_chars, middle_chars, frames``, the output as frames.

    Texts that are empty (null counts as empty) or hold a mark stay plain.  Rows
    with the same id and text give equal outputs, each its own row.  Work is per
    row: nothing is shuffled, a lost task is simply run again.  Other columns are
    not read.  An empty table gives an empty result.
    """
    cut = choose_cuts(store_frames(docs, id_col, text_col, frame_bytes), plain_percent, spm_percent)

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, d = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for n, form, prefix, middle, cell in zip(*(b.column(i).to_pylist() for i in range(1, 5)), b.column(5)):
                own = _frames_of(cell)
                if form != "plain":
                    sections = {"prefix": (0, prefix), "middle": (prefix, prefix + middle), "suffix": (prefix + middle, n)}
                    out, units = [], 0
                    for s in ORDERS[form]:
                        mark = [(len(MARKS[s]), c.compress(MARKS[s]))]
                        for more, z in [*mark, *span(own, *sections[s], c, d)]:
                            units += more
                            out.append((units, z))
                    own = out
                rows.append(own)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], _frame_array(rows)], names=b.schema.names)

    return map_arrow(cut, arrange, cut.schema)


def read_output(fim: DataFrame, restore: bool = False) -> DataFrame:
    """``id, text`` from the frames of ``fill_in_middle``: the output, or with ``restore`` the original text."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            texts = [b"".join(restored(_frames_of(cell), form if restore else "plain", d)).decode()
                     for form, cell in zip(b.column(1).to_pylist(), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    id_type = fim.schema["id"].dataType.simpleString()
    return map_arrow(fim.select("id", "form", "frames"), read, f"id {id_type}, text string")


def output_digest(fim: DataFrame) -> DataFrame:
    """``fim`` with ``output_sha256`` and ``restored_sha256`` in place of the frames, both streamed frame by frame."""
    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = zstandard.ZstdDecompressor()
        for b in batches:
            out, back = [], []
            for form, cell in zip(b.column(2).to_pylist(), b.column(5)):
                own = _frames_of(cell)
                for hashes, how in ((out, "plain"), (back, form)):
                    h = hashlib.sha256()
                    for p in restored(own, how, d):
                        h.update(p)
                    hashes.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.string()), pa.array(back, pa.string())],
                                             names=[*b.schema.names[:5], "output_sha256", "restored_sha256"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fim.schema.fields[:5])
    return map_arrow(fim, digest, fields + ", output_sha256 string, restored_sha256 string")
