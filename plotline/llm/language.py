"""Language identification by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, map_arrow, text_of

#: longest context in bytes: a context and its next byte fit 32 bits
ORDER = 3
#: a byte after a context stays in the tree if it makes up this share of its language's bytes
LEAF_SHARE = 2.0 ** -18
#: predicted for texts without letters
UNKNOWN = "und"
_CHUNK = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def grams(batch_column: pa.Array, order: int = ORDER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, row) of every byte of a binary column, in chunks of bounded size.

    A gram holds the ``order`` bytes before a byte (zero before the beginning)
    and the byte itself; A-Z count as a-z.
    """
    offsets = np.frombuffer(batch_column.buffers()[1], np.int32)[batch_column.offset:][:len(batch_column) + 1]
    data = batch_column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for at in range(int(offsets[0]), int(offsets[-1]), _CHUNK):
        end = min(at + _CHUNK, int(offsets[-1]))
        low = _LOWER[np.concatenate((np.zeros(max(0, order - at), np.uint8), flat[max(0, at - order):end]))]
        first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (at, end - 1))
        bounds = np.clip(offsets[first:last + 2], at, end)
        row = np.repeat(np.arange(first, last + 1), np.diff(bounds))
        since = np.arange(at, end) - offsets[row]             # place in the text
        gram = low[order:].astype(np.uint32)
        for k in range(1, order + 1):
            before = low[order - k:len(low) - k].astype(np.uint32)
            before[since < k] = 0
            gram |= before << np.uint32(8 * k)
        yield gram, row


def _merged(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    by = np.argsort(codes, kind="stable")
    codes, n = codes[by], n[by]
    at = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[at], np.add.reduceat(n, at)


def gram_counts(docs: DataFrame, lang_col: str, text_col: str, order: int = ORDER) -> DataFrame:
    """``lang, gram, n`` over all rows; each task sums its own before anything is shuffled."""
    src = docs.select(F.col(lang_col).cast("string").alias("lang"), F.encode(text_of(text_col), "UTF-8").alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> Iterator[pa.RecordBatch]:
            codes, n = _merged(*(np.concatenate(x) for x in zip(*held)))
            lang = pa.array(np.array(names, dtype=object)[(codes >> np.uint64(32)).astype(np.int64)], pa.string())
            yield pa.RecordBatch.from_arrays([lang, pa.array((codes & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n)],
                                             names=["lang", "gram", "n"])
            held.clear()
            names.clear()

        for b in batches:
            langs = b.column(0).to_pylist()
            at = {x: k for k, x in enumerate(names)}
            for x in langs:
                if x not in at:
                    at[x] = len(names)
                    names.append(x)
            own = np.array([at[x] for x in langs], dtype=np.uint64)
            for gram, row in grams(b.column(1), order):
                code, n = np.unique((own[row] << np.uint64(32)) | gram, return_counts=True)
                held.append((code, n.astype(np.int64)))
                if sum(len(c) for c, _ in held) > 4_000_000:
                    held[:] = [_merged(*(np.concatenate(x) for x in zip(*held)))]
            if held and len(held[0][0]) > 2_000_000:
                yield from rows()
        if held:
            yield from rows()

    part = map_arrow(src, count, "lang string, gram long, n long")
    return part.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class ByteModel:
    """Context trees of all languages, frozen: code length of a gram in every language.

    A context's own symbols cost their count over the context's total; any other
    symbol costs the escape, whose weight is the number of different symbols (plus
    what was pruned), and goes on one byte shorter, where symbols already ruled
    out are left out of the total.  Below the empty context the symbols never
    met share evenly.  Probabilities of the 256 next bytes sum to one.
    """

    def __init__(self, langs: list[str], order: int, leaves: dict[str, np.ndarray]):
        self.langs, self.order = langs, order
        lang, k, ctx, sym, n, total, kinds = (leaves[c] for c in ("lang", "k", "ctx", "sym", "n", "total", "kinds"))
        self.levels: list[dict] = []
        for level in range(order + 1):
            on = k == level
            key = (lang[on].astype(np.uint64) << np.uint64(32)) | (ctx[on].astype(np.uint64) << np.uint64(8)) | sym[on].astype(np.uint64)
            by = np.argsort(key)
            key, n_l = key[by], n[on][by].astype(np.float64)
            ctxs, first, size = np.unique(key >> np.uint64(8), return_index=True, return_counts=True)
            kept = np.add.reduceat(n_l, first) if len(n_l) else np.zeros(0)
            all_, kinds_l = total[on][by][first].astype(np.float64), kinds[on][by][first].astype(np.float64)
            escape = kinds_l + all_ - kept
            here = {"key": key, "n": n_l, "ctx": ctxs, "size": size, "escape": escape, "start": kept + escape}
            if level:
                up = self.levels[-1]
                parent_key = (key & np.uint64(0xFFFFFFFF00000000)) | (key & np.uint64((1 << (8 * level)) - 1))
                out = np.add.reduceat(up["n"][np.searchsorted(up["key"], parent_key)], first) if len(key) else np.zeros(0)
                parent = (ctxs & np.uint64(0xFFFFFF000000)) | (ctxs & np.uint64((1 << (8 * (level - 1))) - 1))
                here["enter_up"] = up["start"][np.searchsorted(up["ctx"], parent)] - out
            self.levels.append(here)

    def bits(self, gram: np.ndarray) -> np.ndarray:
        """Code lengths, one row per gram and one column per language."""
        return np.stack([self._bits(gram, x) for x in range(len(self.langs))], 1) if self.langs else np.zeros((len(gram), 0))

    def _bits(self, gram: np.ndarray, lang: int) -> np.ndarray:
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        g = gram.astype(np.uint64)
        enter = np.full(len(gram), np.nan)                  # total of the next context if a longer one led here
        left = np.full(len(gram), 256.0)                    # symbols below the empty context
        for level in range(self.order, -1, -1):
            t = self.levels[level]
            if not len(t["key"]):
                continue
            base = np.uint64(lang << 32)
            key = base | (g[open_] & np.uint64((1 << (8 * level + 8)) - 1))
            c = np.minimum(np.searchsorted(t["ctx"], key >> np.uint64(8)), len(t["ctx"]) - 1)
            known = t["ctx"][c] == key >> np.uint64(8)
            p = np.minimum(np.searchsorted(t["key"], key), len(t["key"]) - 1)
            hit = known & (t["key"][p] == key)
            whole = np.where(np.isnan(enter[open_]), t["start"][c], enter[open_])
            out[open_[hit]] += np.log2(whole[hit] / t["n"][p[hit]])
            miss = known & ~hit
            out[open_[miss]] += np.log2(whole[miss] / t["escape"][c[miss]])
            if level:
                enter[open_[known]] = t["enter_up"][c[known]]
            else:
                left[open_[known]] = 256 - t["size"][c[known]]
            open_ = open_[~hit]
        out[open_] += np.log2(np.maximum(left[open_], 1))
        return out


def train_language(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", order: int = ORDER,
                   leaf_share: float = LEAF_SHARE) -> ByteModel:
    """Context trees from the texts of all rows with a language; null and empty texts add nothing.

    Counts cover every byte.  A leaf stays if its count is at least ``leaf_share``
    of its language's bytes, so a level of a language has at most 1/leaf_share
    leaves whatever the input: that bounds what the driver and the tasks hold.
    """
    if not 1 <= order <= 3:
        raise ValueError("order is 1 to 3: a context and its next byte fit 32 bits")
    deep = cut(gram_counts(docs.where(F.col(lang_col).isNotNull()), lang_col, text_col, order))
    least = deep.groupBy("lang").agg((F.sum("n") * leaf_share).alias("least"))
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.expr(f"(gram & {(1 << (8 * k + 8)) - 1}L)").alias("g"))
                                 for k in range(order + 1)]))
    every = (deep.select("lang", "n", levels.alias("x")).groupBy("lang", "x.k", "x.g").agg(F.sum("n").alias("n"))
             .select("lang", "k", F.shiftright("g", 8).alias("ctx"), F.expr("g & 255L").alias("sym"), "n"))
    # at most 256 symbols follow a context
    ctx = (every.join(least, "lang").groupBy("lang", "k", "ctx")
           .agg(F.sum("n").alias("total"), F.count("*").alias("kinds"),
                F.collect_list(F.when(F.col("n") >= F.col("least"), F.struct("sym", "n"))).alias("own")))
    t = ctx.select("lang", "k", "ctx", "total", "kinds", F.inline("own")).toArrow()
    names = sorted(set(t.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(names)}
    leaves = {c: t.column(c).to_numpy() for c in ("k", "ctx", "sym", "n", "total", "kinds")}
    leaves["lang"] = np.array([at[x] for x in t.column("lang").to_pylist()], dtype=np.int64)
    return ByteModel(names, order, leaves)


def identify_language(docs: DataFrame, model: ByteModel, id_col: str = "doc_id", text_col: str = "text",
                      carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per input row: ``id, lang_pred, score, bits`` and the columns of ``carry``.

    ``bits`` is the exact code length of the whole text in each language, in the
    order of ``model.langs``; the shortest wins, ties go to the first name.
    ``score`` is the winner's share if all languages are equally likely before.  A
    text that is null, empty or without a letter, and any text if no language was
    learned, is ``und`` with score 0.  Rows are independent of each other, repeated
    rows included.  Other columns are not read; an empty table gives an empty result.
    """
    carry = carry or {}
    letters = F.coalesce(text_of(text_col).rlike(r"\p{L}"), F.lit(False))
    src = docs.select(F.col(id_col).alias("id"), letters.alias("letters"), *[c.alias(n) for n, c in carry.items()],
                      F.encode(text_of(text_col), "UTF-8").alias("t"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    n_langs = len(model.langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        known, cost = np.zeros(0, np.uint32), np.zeros((0, n_langs))
        for b in batches:
            total = np.zeros((b.num_rows, n_langs))
            for gram, row in grams(b.column(b.num_columns - 1), m.order):
                if not n_langs:
                    break
                u, place = np.unique(gram, return_inverse=True)
                if len(known) > 1_000_000:                  # only saves repeated look-ups
                    known, cost = known[:0], cost[:0]
                new = u[~np.isin(u, known, assume_unique=True)]
                known, cost = np.concatenate((known, new)), np.concatenate((cost, m.bits(new)))
                by = np.argsort(known)
                known, cost = known[by], cost[by]
                own = cost[np.searchsorted(known, u)]
                first = int(row[0])
                for x in range(n_langs):
                    sums = np.bincount(row - first, weights=own[place, x])
                    total[first:first + len(sums), x] += sums
            named = np.array(b.column(1).to_pylist(), dtype=bool) & bool(n_langs)
            best = total.argmin(1) if n_langs else np.zeros(b.num_rows, np.int64)
            gap = total - total.min(1, keepdims=True) if n_langs else total
            share = 1 / np.exp2(-gap).sum(1) if n_langs else np.zeros(b.num_rows)
            pred = np.array([*m.langs, UNKNOWN], dtype=object)[np.where(named, best, n_langs)]
            flat = pa.ListArray.from_arrays(pa.array((np.arange(b.num_rows + 1) * n_langs).astype(np.int32)), pa.array(total.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pred, pa.string()), pa.array(np.where(named, share, 0.0)), flat, *b.columns[2:-1]],
                names=["id", "lang_pred", "score", "bits", *b.schema.names[2:-1]])

    fields = [f"id {src.schema['id'].dataType.simpleString()}", "lang_pred string", "score double", "bits array<double>"]
    fields += [f"{n} {src.schema[n].dataType.simpleString()}" for n in carry]
    return map_arrow(src, score, ", ".join(fields))
