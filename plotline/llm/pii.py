"""PII: exact identifiers by pattern, and information-theoretic sanitisation of terms that reveal them.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, text_of

KINDS = ("email", "ip", "card", "phone")

# The identifier patterns.  Quantifiers are possessive, and starts
# inside a run are ruled out, wherever that cannot change a match: long runs are
# then read once, without recursion.
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_LABEL}++(?:\.{_LABEL}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# cheap necessary conditions that spare most texts the pattern
_GUARDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
TERM = r"[\p{L}\p{N}]++"

#: code points on either side of an identifier that tell its contexts apart
CONTEXT_CHARS = 80
#: different contexts of an identifier whose documents must hold a term for it to count as evidence
MIN_CONTEXTS = 2
#: standard deviations of the bound below which the share of a term's documents that hold the identifier is not trusted
CONFIDENCE = 1.96
#: share of an identifier's information a term must give away to be generalised, or removed
GENERALISE_AT, REMOVE_AT = 0.8, 0.95

_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


#: spans folded together: longer lists are cut into parts, so no list or text is copied once per span
_PART = 512
#: matches folded together: each step of a fold copies all that the steps before it found
_BLOCK = 16


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _parts(items: Column, size: int = _PART) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(size)),
                       lambda s: F.slice(items, s, F.lit(size)))


def matches(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] = lambda value: F.lit(True)) -> Column:
    """Non-overlapping matches from the left, as ``kind, start, end, value`` in code points; those stay whose value passes ``keep``."""
    cuts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
                        F.split(text, pattern, -1).alias("g"))

    def folded(pos: Column, out: Column) -> Column:
        return F.struct(pos.alias("pos"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + F.char_length(x["g"])
        end = start + F.char_length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), x["m"].alias("value"))
        return folded(end, F.when(keep(x["m"]), F.array_append(acc["out"], span)).otherwise(acc["out"]))

    def of_block(block: Column) -> Column:      # places from the beginning of the block
        return F.aggregate(block, folded(F.lit(0), F.array().cast(_SPAN)), step)

    def joined(pieces: Column) -> Column:       # places from the beginning of the first piece
        def moved(lengths: Column) -> Column:
            def one(p: Column, i: Column) -> Column:
                before = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda a, x: a + x)
                return F.when(F.size(p["out"]) == 0, p["out"]).otherwise(_let(before, lambda at: F.transform(p["out"], lambda s: F.struct(
                    s["kind"].alias("kind"), (s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["value"].alias("value")))))
            return folded(F.aggregate(lengths, F.lit(0), lambda a, x: a + x), F.flatten(F.transform(pieces, one)))
        return F.when(F.size(pieces) == 1, pieces[0]).otherwise(_let(F.transform(pieces, lambda p: p["pos"]), moved))

    def of_part(part: Column) -> Column:
        return _let(F.transform(_parts(part, _BLOCK), of_block), joined)

    own = F.filter(cuts, lambda x: x["m"].isNotNull())
    return _let(_let(own, lambda x: F.transform(_parts(x), of_part)), joined)["out"]


def _stitched(text: Column, spans: Column, tied: Callable[[Column], Column], step: Callable, rest: Callable) -> Column:
    """A text put together from the gaps between spans, sorted by start.

    ``step(state, span, gap)`` gives what stands for the gap and a span that begins
    at or after ``state.pos``, the end of all spans before; ``rest(state, gap)`` closes
    the text.  ``state.tied`` is ``tied`` of the span that reached furthest.
    """
    def state(pos: Column, flag: Column) -> Column:
        return F.struct(pos.alias("pos"), flag.alias("tied"))

    nowhere = state(F.lit(0), F.lit(False))

    def furthest(done: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(done, lambda s: state(s["end"], tied(s)))), nowhere)

    def of_part(part: Column, before: Column, own: Column) -> Column:
        def add(acc: Column, s: Column) -> Column:
            gap = own.substr(acc["pos"] - before["pos"] + 1, s["start"] - acc["pos"])
            return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"),
                            F.when(s["end"] > acc["pos"], tied(s)).otherwise(acc["tied"]).alias("tied"),
                            F.concat(acc["out"], F.coalesce(step(acc, s, gap), F.lit(""))).alias("out"))
        begin = F.struct(before["pos"].alias("pos"), before["tied"].alias("tied"), F.lit("").alias("out"))
        return F.aggregate(part, begin, add, lambda acc: acc["out"])

    def whole(parts: Column, ends: Column) -> Column:
        def one(part: Column, i: Column) -> Column:
            before = F.coalesce(F.array_max(F.slice(ends, F.lit(1), i)), nowhere)
            return _let(before, lambda b: _let(text.substr(b["pos"] + 1, F.greatest(ends[i]["pos"] - b["pos"], F.lit(0))),
                                               lambda own: of_part(part, b, own)))

        tail = _let(F.array_max(ends), lambda end: rest(end, text.substr(end["pos"] + 1, F.char_length(text))))
        return F.concat(F.array_join(F.transform(parts, one), ""), tail)

    return _let(_parts(spans), lambda parts: _let(F.transform(parts, furthest), lambda ends: whole(parts, ends)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid_ip(value: Column) -> Column:
    def small(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= F.lit("255")))
    return F.forall(F.split(value, r"\."), small)


def _valid_card(value: Column) -> Column:
    digits = F.reverse(_digits(value))
    n = F.length(digits)

    def weighed(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return d - F.when(d > 9, 9).otherwise(0)
    luhn = F.aggregate(F.transform(F.sequence(F.lit(1), n), weighed), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(16, 19), luhn % 10 == 0).otherwise(False)


_VALID = {
    "email": lambda v: F.lit(True),
    "ip": _valid_ip,
    "card": _valid_card,
    "phone": lambda v: F.length(_digits(v)).between(8, 15),
}


def _of_kind(text: Column, kind: str) -> Column:
    return F.when(_GUARDS[kind](text), matches(text, PATTERNS[kind], kind, _VALID[kind])).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    """All identifiers of a text, by kind as listed, then by start."""
    return F.concat(*[_of_kind(text, k) for k in KINDS])


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _words(text: Column) -> Column:
    """The different words of a text, lower-cased."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


#: stands for a character that belongs to an identifier; neither a letter nor a digit
_MASK = "\ue000"


def _masked(text: Column, base: Column) -> Column:
    """The text with every identifier, and the letters and digits joined to it, masked character by character."""
    joined = r"[\p{L}\p{N}]"

    def untied(state: Column, gap: Column) -> Column:
        return F.when(state["tied"], F.regexp_replace(gap, rf"\G{joined}", _MASK)).otherwise(gap)

    def step(state: Column, s: Column, gap: Column) -> Column:
        gap = untied(state, gap)
        gap = F.when(s["value"].rlike(f"^{joined}"), F.regexp_replace(gap, rf"{joined}(?={joined}*+$)", _MASK)).otherwise(gap)
        fresh = s["end"] - F.greatest(s["start"], state["pos"])
        return F.when(fresh > 0, F.concat(F.when(s["start"] > state["pos"], gap).otherwise(""), F.repeat(F.lit(_MASK), fresh)))

    spans = F.sort_array(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                              s["value"].alias("value"))))
    return _stitched(text, spans, lambda s: s["value"].rlike(f"{joined}$"), step, untied)


def _places(marked: DataFrame, context_chars: int) -> DataFrame:
    """A row per place of an identifier: ``row, kind, value``, its context's hash and the words inside it.

    Texts are cut part by part, so a long one is not read from its beginning for each place.
    """
    width = F.char_length("t")
    joined = r"[\p{L}\p{N}]"

    def of_part(part: Column) -> Column:
        lo = F.greatest(F.lit(0), F.array_min(F.transform(part, lambda s: s["start"])) - context_chars)
        hi = F.least(width, F.array_max(F.transform(part, lambda s: s["end"])) + context_chars)

        def cut_out(own: Column) -> Column:
            def place(s: Column) -> Column:
                a, b = F.greatest(F.lit(0), s["start"] - context_chars), F.least(width, s["end"] + context_chars)
                clear = own["masked"].substr(a - own["lo"] + 1, b - a)
                # a word cut by either end of the context is not inside it
                clear = F.when(a > 0, F.regexp_replace(clear, f"^{joined}++", "")).otherwise(clear)
                clear = F.when(b < width, F.regexp_replace(clear, f"(?<!{joined}){joined}++$", "")).otherwise(clear)
                near = F.transform(F.regexp_extract_all(clear, F.lit(TERM), F.lit(0)), F.lower)
                return F.struct(s["kind"].alias("kind"), s["value"].alias("value"),
                                F.xxhash64(own["t"].substr(a - own["lo"] + 1, b - a)).alias("context"), near.alias("near"))
            return F.transform(part, place)

        return _let(F.struct(lo.alias("lo"), hi.alias("hi")), lambda x: _let(F.struct(
            x["lo"].alias("lo"), F.col("t").substr(x["lo"] + 1, x["hi"] - x["lo"]).alias("t"),
            F.col("masked").substr(x["lo"] + 1, x["hi"] - x["lo"]).alias("masked")), cut_out))

    by_start = F.sort_array(F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                                   s["kind"].alias("kind"), s["value"].alias("value"))))
    return marked.select("row", F.explode(F.flatten(F.transform(_parts(by_start), of_part))).alias("p")).select("row", "p.*")


def wilson_low(hits: Column, n: Column, z: float) -> Column:
    """Lower bound of a share ``hits / n`` (Wilson score); the share itself for ``z`` 0."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(found: DataFrame, context_chars: int, min_contexts: int, generalise_at: float,
                     confidence: float = CONFIDENCE) -> DataFrame:
    """``(kind, value, term, share)``: terms giving away at least ``generalise_at`` of an identifier.

    Over all documents, the information a term t carries on an identifier e is
    PMI(t, e) = log2(N * co / (df_t * df_e)), out of IC(e) = log2(N / df_e); the
    share is their ratio (1: whoever reads t knows e).  Few documents prove little,
    and chance pairs grow with the corpus, so co / df_t enters as its lower bound at
    ``confidence`` standard deviations.  All four count rows of
    ``found``, whole documents: co those that hold e, and t anywhere outside
    identifiers; df_t those with the word t.

    A context of e is the text around one of its places.  A document brings t the
    contexts in which t stands itself, or, when t stands further away only, one
    of the document's contexts of e; terms with fewer than ``min_contexts``
    different ones are no evidence, so copies count once.  Identifiers with fewer
    contexts can have no such term, and their documents' words are not counted.
    """
    n_docs = found.count()
    # written before it is read, so that the row numbers stay
    marked = cut(found.where(F.size("base") > 0).select(F.monotonically_increasing_id().alias("row"), "t", "base",
                                                        _masked(F.col("t"), F.col("base")).alias("masked")))
    places = cut(_places(marked, context_chars))
    ids = cut(places.groupBy("kind", "value").agg(F.count_distinct("row").alias("df_e"),
                                                  F.count_distinct("context").alias("contexts"))
              .where(F.col("contexts") >= min_contexts).select("kind", "value", "df_e"))
    held = places.join(ids, ["kind", "value"], "left_semi").groupBy("row", "kind", "value").agg(
        F.min("context").alias("home"), F.collect_list(F.struct("context", "near")).alias("places"))
    words = marked.select("row", _words(F.col("masked")).alias("terms"))
    pairs = held.join(words, "row").select("kind", "value", "home", "places", F.explode("terms").alias("term"))
    beside = F.array_distinct(F.transform(F.filter("places", lambda p: F.array_contains(p["near"], F.col("term"))),
                                          lambda p: p["context"]))
    pairs = pairs.select("kind", "value", "term", F.posexplode(
        F.when(F.size(beside) > 0, beside).otherwise(F.array("home"))).alias("k", "context"))
    both = cut(pairs.groupBy("kind", "value", "term").agg(
        F.count_distinct("context").alias("contexts"), F.sum((F.col("k") == 0).cast("long")).alias("co"))
        .where(F.col("contexts") >= min_contexts))
    # counted in the tasks before anything is sent, so what is moved follows the input at any number of terms
    df_t = found.select(F.explode(_words(F.col("t"))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t"))
    risk = both.join(ids, ["kind", "value"]).join(df_t, "term")
    total = F.log2(F.lit(float(max(n_docs, 1))) / F.col("df_e"))
    lost = -F.log2(wilson_low(F.col("co"), F.col("df_t"), confidence))
    risk = risk.where(total > 0).withColumn("share", 1 - lost / total)
    return risk.where(F.col("share") >= generalise_at).select("kind", "value", "term", "share")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context_chars: int = CONTEXT_CHARS,
             min_contexts: int = MIN_CONTEXTS, generalise_at: float = GENERALISE_AT,
             remove_at: float = REMOVE_AT, confidence: float = CONFIDENCE) -> DataFrame:
    """All columns of ``docs`` plus ``pii`` (struct: ``base``, ``terms``, ``clean``), one row per input row.

    A column of that name is replaced; any other column, whatever its name, is
    passed on.  An empty table gives an empty result.

    ``base`` are the identifiers (email, IPv4, payment card with Luhn, phone)
    with code point spans.  ``terms`` are the words that disclose any identifier
    by corpus co-occurrence over whole documents (``disclosing_terms``), seen in
    documents of at least ``min_contexts`` different contexts of it
    (``context_chars`` on either side; copies count once), at every place outside
    identifiers where they stand, in every document, whether or not it holds the
    identifier.  The action is "generalise" or, from ``remove_at`` on, "remove",
    by the identifier that the word gives away most of.
    ``clean`` is the text with identifiers and generalised terms
    replaced by labels and removed terms taken out; null text stays null and
    has no spans.  Base spans never depend on the terms.

    Counts are taken over all documents and aggregated map-side.  Rows are told
    apart by (id, text), so null and repeated ids need no care.
    """
    found = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"))
    found = found.select("id", F.xxhash64("t").alias("th"), "t", base_spans(F.col("t")).alias("base"))
    action = F.when(F.max("share") >= remove_at, "remove").otherwise("generalise")
    risky = cut(disclosing_terms(found, context_chars, min_contexts, generalise_at, confidence)
                .groupBy("term").agg(action.alias("action")))
    hits = found.select("id", "th", F.explode(_words(F.col("t"))).alias("term")).join(risky, "term")
    terms = cut(hits.groupBy("id", "th").agg(F.map_from_entries(F.collect_set(F.struct("term", "action"))).alias("_risky"))
                .select(F.col("id").alias("_term_id"), F.col("th").alias("_term_th"), "_risky"))

    # the work happens beside the caller's columns, which travel in one struct
    taken = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    rows = taken.withColumn("_th", F.xxhash64(text_of("_text")))
    # merged at any size: the table of risky words grows with the documents
    rows = rows.join(terms.hint("merge"), F.col("_id").eqNullSafe(F.col("_term_id")) & (F.col("_th") == F.col("_term_th")), "left")
    rows = rows.withColumn("_base", base_spans(text_of("_text")))

    # words of identifiers are masked, so every word met is outside of them
    clear = _let(_masked(text_of("_text"), F.col("_base")), lambda t: matches(
        t, TERM, "term", lambda word: F.map_contains_key("_risky", F.lower(word))))
    spans = F.transform(clear, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"),
        F.element_at("_risky", F.lower(s["value"])).alias("action")))
    none = F.array().cast("array<struct<start:int,end:int,value:string,action:string>>")
    rows = rows.withColumn("_terms", F.when(F.col("_risky").isNotNull(), spans).otherwise(none))
    clean = F.when(F.col("_text").isNotNull(), _replaced(text_of("_text")))
    kept = [F.col("_row")[c].alias(c) for c in docs.columns if c != "pii"]
    done = rows.select("_row", F.struct(F.col("_base").alias("base"), F.col("_terms").alias("terms"), clean.alias("clean")).alias("_pii"))
    return done.select(*kept, F.col("_pii").alias("pii"))


def _replaced(text: Column) -> Column:
    def of_term(s: Column) -> Column:
        label = (F.when(s["action"] == "remove", "")
                 .when(s["value"].rlike("^[0-9]+$"), "[NUMBER]").otherwise("[TERM]"))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), label.alias("label"))

    def of_base(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["end"].alias("end"),
                        F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("label"))

    def step(state: Column, s: Column, gap: Column) -> Column:
        return F.when(s["start"] >= state["pos"], F.concat(gap, s["label"]))        # a span inside the one before only widens it

    spans = F.sort_array(F.concat(F.transform("_base", of_base), F.transform("_terms", of_term)))
    whole = _stitched(text, spans, lambda s: F.lit(False), step, lambda state, gap: gap)
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def pii_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts per kind, the hash of the base spans and the list of all spans."""
    base = F.col("pii.base")

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    terms = F.transform("pii.terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"),
                                                        s["end"].alias("end"), s["value"].alias("value")))
    return found.select(F.col(id_col).alias("doc_id"), *map(count, KINDS), F.sha2(span_list(base), 256).alias("base_sha256"),
                        span_list(F.concat(base, terms)).alias("spans"))
