"""Token table of an HTML page and selector look-ups over it.

``with_tokens`` cuts every page once, in a single pass, into an array of tokens in
page order.  A token is a tag and the text that follows it:

    pos, tag (lower case), kind (1 start, -1 end, 0 empty element, comment or script),
    depth (open elements of the same tag, relative to the page), end (token of the own
    end tag, null without one), classes (' a b '), id, markup, text

End tags are matched without walking a tree: running sums of +1 and -1 give every
token its depth among the tokens of its tag, and after sorting by (tag, depth,
place) a start tag's own end tag is its neighbour.  Everything is a column
expression; a look-up reads the array only.

The helpers build SQL text, not Column objects: the nested lambdas of one look-up
would otherwise cost hundreds of calls into the JVM, and planning a page query
seconds.  An argument is the SQL of a value, the result is SQL as well.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: HTML elements that never have content ----------------------
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
# -------------------------------------------------------------------------------

_TAG = r"""</?[a-zA-Z](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
#: group 1: comment, script or style with its content, tag, or anything else in angle brackets; group 2: the text up to the next
TOKEN = (r"(?is)(<!--.*?(?:-->|\z)|<(?:script|style)\b[^>]*>.*?(?:</(?:script|style)\s*>|\z)|" + _TAG
         + r"|<[a-zA-Z/!?][^<>]*>?|^)([^<]*+(?:<(?![a-zA-Z/!?])[^<]*+)*+)")
#: tokens whose running sums are folded together
_CHUNK = 64

Sql = str
Body = Callable[[Sql], Sql]
_names = count()


def literal(value: str) -> Sql:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def name(column: str) -> Sql:
    return "`" + column.replace("`", "``") + "`"


def each(array: Sql, body: Body) -> Sql:
    x = f"x{next(_names)}"
    return f"transform({array}, {x} -> {body(x)})"


def keep(array: Sql, pred: Body) -> Sql:
    x = f"x{next(_names)}"
    return f"filter({array}, {x} -> {pred(x)})"


def let(value: Sql, body: Body) -> Sql:
    """``body(value)`` with ``value`` computed once, however often the body uses it.

    The finish of an aggregate, which hands its result on: a ``transform`` would
    copy it, for a token array every token with its texts."""
    x = f"x{next(_names)}"
    return f"aggregate(array(0), {value}, ({x}, n) -> {x}, {x} -> {body(x)})"


def once(df: DataFrame, **cols: Sql) -> DataFrame:
    """``df`` with named columns that are computed in one place: the optimiser neither repeats
    them in later expressions nor moves them into filters (they come out of a generator)."""
    return df.select("*", F.expr("inline(array(struct(" + ", ".join(f"{c} AS {n}" for n, c in cols.items()) + ")))"))


def attribute(markup: Sql, attr: str) -> Sql:
    """Value of an attribute, quoted or not; empty if absent."""
    pattern = rf"""(?is)\s{attr}\s*=\s*(["']?)(.*?)\1(?=[\s/>]|$)"""
    return f"regexp_extract({markup}, {literal(pattern)}, 2)"


def _running_sums(values: Sql) -> Sql:
    """Running sums of an int array: of each chunk, then of the chunks, so that no long array is copied per token."""
    def sums(part: Sql) -> Sql:
        a, x = f"a{next(_names)}", f"x{next(_names)}"
        return (f"aggregate({part}, named_struct('sum', 0, 'every', slice({part}, 1, 0)), "
                f"({a}, {x}) -> named_struct('sum', {a}.sum + {x}, 'every', array_append({a}.every, {a}.sum + {x}))).every")

    def chunked(v: Sql) -> Sql:
        return each(f"sequence(1, greatest(size({v}), 1), {_CHUNK})", lambda s: let(f"slice({v}, {s}, {_CHUNK})", sums))

    def joined(chunks: Sql) -> Sql:
        totals = let(each(chunks, lambda c: f"coalesce(get({c}, size({c}) - 1), 0)"), sums)
        c, i = f"c{next(_names)}", f"i{next(_names)}"
        return let(totals, lambda before: f"flatten(transform({chunks}, ({c}, {i}) -> "
                   + each(c, lambda x: f"{x} + if({i} > 0, get({before}, {i} - 1), 0)") + "))")

    return let(let(values, chunked), lambda chunks: f"if(size({chunks}) = 1, {chunks}[0], {joined(chunks)})")


def tokens(html: Sql) -> Sql:
    """Array of tokens of one page (null for a null page)."""
    pattern, void = literal(TOKEN), ", ".join(literal(t) for t in ("", "script", "style", *VOID_TAGS))
    pieces = (f"zip_with(regexp_extract_all({html}, {pattern}, 1), regexp_extract_all({html}, {pattern}, 2), "
              "(m, x) -> named_struct('markup', m, 'text', x))")

    def token(p: Sql) -> Sql:
        m = f"{p}.markup"
        spaced = f"translate({attribute(m, 'class')}, '\\t\\n\\r\\u000C', '    ')"
        tag = f"lower(regexp_extract({m}, {literal('^</?([a-zA-Z][^' + chr(92) + 's/>]*)')}, 1))"
        return (f"named_struct('pos', i, 'tag', {tag}, 'classes', if(contains({m}, 'class'), concat(' ', {spaced}, ' '), ''), "
                f"'id', if(contains({m}, 'id'), {attribute(m, 'id')}, ''), 'markup', {m}, 'text', {p}.text)")

    def matched(found: Sql) -> Sql:
        by_tag = "sort_array(" + each(found, lambda t: (
            f"named_struct('tag', {t}.tag, 'pos', {t}.pos, 'kind', CASE WHEN {t}.tag IN ({void}) OR endswith({t}.markup, '/>') THEN 0 "
            f"WHEN startswith({t}.markup, '</') THEN -1 ELSE 1 END)")) + ")"

        def depths(rows: Sql) -> Sql:
            # an end tag stands at the depth of the element it closes
            return (f"sort_array(zip_with({rows}, {_running_sums(each(rows, lambda r: f'{r}.kind'))}, (r, s) -> "
                    "named_struct('tag', r.tag, 'depth', if(r.kind = -1, s + 1, s), 'pos', r.pos, 'kind', r.kind)))")

        def ends(rows: Sql) -> Sql:
            after = f"get({rows}, i + 1)"
            own = f"r.kind = 1 AND {after}.kind = -1 AND {after}.tag = r.tag AND {after}.depth = r.depth"
            return (f"sort_array(transform({rows}, (r, i) -> "
                    f"named_struct('pos', r.pos, 'kind', r.kind, 'depth', r.depth, 'end', if({own}, {after}.pos, NULL))))")

        return (f"zip_with({found}, {let(let(by_tag, depths), ends)}, (t, p) -> named_struct('pos', t.pos, 'tag', t.tag, 'kind', p.kind, "
                "'depth', p.depth, 'end', p.end, 'classes', t.classes, 'id', t.id, 'markup', t.markup, 'text', t.text))")

    every = f"transform({pieces}, (p, i) -> {token('p')})"
    return f"if({html} IS NOT NULL, {let(every, matched)}, NULL)"


def with_tokens(df: DataFrame, html_col: str = "html", token_col: str = "tokens") -> DataFrame:
    """``df`` with the token array of each page, computed once per page."""
    return once(df, **{token_col: tokens(name(html_col))})


# --- look-ups over a token array (a whole page or a part of it) ---------------------------------

def by_class(*classes: str, tag: str | None = None) -> Body:
    """Elements holding all the classes, among others and in any order."""
    return lambda t: " AND ".join([f"contains({t}.classes, {literal(f' {c} ')})" for c in classes]
                                  + ([f"{t}.tag = {literal(tag)}"] if tag else []))


def by_tag(*tags: str) -> Body:
    return lambda t: f"{t}.tag IN ({', '.join(map(literal, tags))})"


def by_id(value: str) -> Body:
    return lambda t: f"{t}.id = {literal(value)}"


def select(toks: Sql, pred: Body) -> Sql:
    """Start tags for which ``pred`` holds, in page order."""
    return keep(toks, lambda t: f"{t}.kind = 1 AND {pred(t)}")


def select_one(toks: Sql, pred: Body) -> Sql:
    """The first such element (null if there is none)."""
    return f"get({select(toks, pred)}, 0)"


def _end(toks: Sql, e: Sql) -> Sql:
    """Where an element ends: at its own end tag, else with the element around it, else with the tokens."""
    around = each(keep(toks, lambda t: f"{t}.pos < {e}.pos AND {t}.end > {e}.pos"), lambda t: f"{t}.end")
    return f"coalesce({e}.end, array_min({around}), {2 ** 31 - 1})"


def _between(toks: Sql, first: Sql, end: Sql) -> Sql:
    """Tokens from place ``first`` of the page up to ``end``; ``toks`` is a page or a run of its tokens without gaps."""
    return f"slice({toks}, {first} - get({toks}, 0).pos + 1, {end} - ({first}))"


def inner(toks: Sql, element: Sql) -> Sql:
    """Tokens inside an element (empty without the element)."""
    return let(element, lambda e: let(_end(toks, e), lambda end: (
        f"if({e} IS NULL, slice({toks}, 1, 0), {_between(toks, f'{e}.pos + 1', end)})")))


def inside(toks: Sql, pred: Body) -> Sql:
    """Tokens inside the first element that ``pred`` selects."""
    return let(toks, lambda ts: inner(ts, select_one(ts, pred)))


def content(toks: Sql, element: Sql, line_break: str = "") -> Sql:
    """All text of an element, its inner elements' included; null without the element."""
    def text(t: Sql) -> Sql:
        return f"if({t}.tag = 'br', concat({literal(line_break)}, {t}.text), {t}.text)" if line_break else f"{t}.text"
    return let(element, lambda e: let(_end(toks, e), lambda end: (
        f"if({e} IS NULL, NULL, array_join({each(_between(toks, f'{e}.pos', end), text)}, ''))")))


def first_text(toks: Sql, pred: Body) -> Sql:
    return let(toks, lambda ts: content(ts, select_one(ts, pred)))


def texts(toks: Sql, pred: Body, line_break: str = "") -> Sql:
    return let(toks, lambda ts: each(select(ts, pred), lambda e: content(ts, e, line_break)))


def text_at(toks: Sql, pos: Sql) -> Sql:
    """Text that follows the token at ``pos``."""
    return f"get({toks}, {pos} - get({toks}, 0).pos).text"


def per_item(toks: Sql, value: Body) -> Sql:
    """``value(tokens of the item)`` per list item, nested ones included, so one irregular item never shifts the others."""
    return let(toks, lambda ts: each(select(ts, by_tag("li")), lambda li: let(inner(ts, li), value)))


def picked(values: Sql, *places: int) -> Sql:
    """The values at the given places (null past the end) as an array."""
    return let(values, lambda v: "array(" + ", ".join(f"get({v}, {i})" for i in places) + ")")
