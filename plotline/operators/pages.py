"""Field, link and text extraction from a table of fetched HTML pages (H1–H6).

Each page is one row.  Listing pages are cut once into a token array (see
``markup``) and every field is a look-up over it; links, pagination and the
generic page layout are single regular expressions over the page.  All of it is
native column expressions with no per-row Python.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attribute_name, html_unescape, paragraphs_to_text, pre_clean, squash_whitespace
from ..functions._util import as_col, quote
from . import markup as M

# --- fixed values: listing page layout --------------------------------------
# post date:      <div class="text-gray text-100">…</div>
# seller:         block class "user-info-name" holding <a href=".../user/<id>">name</a>
# breadcrumb:     <ul class="crumb text-medium crumb-text"> li/span items 2..5 =
#                 property type, province, district, ward
# price box:      class "price-box", first span total price, second price per m² ('--' if absent)
# listing code:   class "product-status", first div, second span
# info list:      class "product-infomation" li items 1..6 = area, length, width,
#                 direction, bedrooms, bathrooms (text after the <i> icon)
# description:    id "content-tab-custom", its p and ul/li elements
# details:        id "content-tab-info" li items: <span><span>key</span></span><span>value</span>
# detail key removed after normalisation: DienTichSuDung
# amenity groups: div "tabs-product", h2 headings from the third on, each paired with a
#                 ul "product-other-utilities" list of li/span items
# listing links:  <p class="name-product"><a href="…">
# pagination:     class "pagination" page-item entries; last page = second-to-last entry
# ---------------------------------------------------------------------------
_DESC, _DETAIL = "content-tab-custom", "content-tab-info"
MISSING_PRICE_PER_M2 = "--"
REMOVED_DETAIL_KEYS = ("DienTichSuDung",)


def _class(*names: str) -> str:
    """Pattern of a class attribute holding all ``names``, among others and in any order."""
    return 'class="' + "".join(rf'(?=(?:[^"]*\s)?{n}[\s"])' for n in names) + '[^"]*"'


_LISTING_LINK = rf'(?s)<p\s[^>]*?{_class("name-product")}[^>]*>\s*<a\s[^>]*?href="([^"]*)"'
_PAGE_ITEM = rf'(?s){_class("page-item")}[^>]*>\s*(?:<[^>]+>\s*)*([^<]*?)\s*<'

# Generic page layout of the driver's `pages` table.
GENERIC_FIELDS = {
    "lang": r'<html lang="([^"]*)"',
    "title": r"(?s)<title>(.*?)</title>",
    "h1": r"(?s)<h1>(.*?)</h1>",
    "ad": r'(?s)<div class="ad">(.*?)</div>',
}
GENERIC_BODY = r"(?s)<article>(.*?)</article>"
# a paragraph runs to its end tag, the next paragraph, or the end; tags inside are dropped from its text
GENERIC_PARAGRAPH = r"(?s)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|\z)"
GENERIC_NAV_LINK = r'<a href="([^"]*)">([^<]*)</a>'


def _extract(html: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(html, pattern, group)


def _nullif_empty(c: Column) -> Column:
    return F.when(c == "", F.lit(None).cast("string")).otherwise(c)


def _items(block: Column, item: str) -> Column:
    """All ``item`` matches inside a block (empty array if none)."""
    return F.regexp_extract_all(block, F.lit(item), 1)


def extract_fields(df: DataFrame, html_col: str, fields: Mapping[str, str],
                   unescape: bool = True) -> DataFrame:
    """Generic H1: one column per (name → pattern, group 1); no match → null."""
    html = as_col(html_col)
    names = list(fields)
    raw = F.array(*[_extract(html, fields[n]) for n in names])
    return _decoded_fields(df, raw, names, unescape)


def _decoded_fields(df: DataFrame, raw: Column, names, unescape: bool = True) -> DataFrame:
    """Clean every raw field of one row with ONE decoder expression: the
    fields travel as an array that is decoded once, then split by position."""
    def clean(x):
        return _nullif_empty(squash_whitespace(html_unescape(x) if unescape else x))
    tmp = "__fields"
    out = df.select("*", F.inline(F.array(F.struct(F.transform(raw, clean).alias(tmp)))))    # computed once, see markup.once
    return out.select(*[F.col(quote(c)) for c in df.columns],
                      *[F.element_at(F.col(tmp), i + 1).alias(n) for i, n in enumerate(names)])


def description_text(body: Column, para: str = GENERIC_PARAGRAPH) -> Column:
    """H6: paragraphs of a body block → '.'-terminated sentences joined by a space → F5 clean-up."""
    br = F.transform(_items(body, para),
                     lambda p: html_unescape(F.rtrim(F.regexp_replace(
                         F.regexp_replace(p, r"(?i)<br\s*/?>", " "), r"<[^>]*>", ""))))
    return pre_clean(paragraphs_to_text(br))


def page_fields(df: DataFrame, html_col: str = "html") -> DataFrame:
    """H1/H6 on generic pages: lang, title, h1, ad text, paragraph count, description."""
    body = _extract(as_col(html_col), GENERIC_BODY)
    out = extract_fields(df, html_col, GENERIC_FIELDS)
    return out.select("*", F.size(_items(body, GENERIC_PARAGRAPH)).alias("n_paragraphs"),
                      description_text(body).alias("description"))


def _after_icon(item: str) -> str:
    """Text after the icon in the first span of a list item."""
    return M.let(M.inside(item, M.by_tag("span")), lambda span: M.let(
        M.select_one(span, M.by_tag("i")), lambda i: M.text_at(span, f"coalesce({i}.end, {i}.pos)")))


def listing_fields(df: DataFrame, html_col: str = "html") -> DataFrame:
    """H1: the listing record fields of a listing page (one row per page).

    The description holds every paragraph and list item as a sentence, a nested
    item in its parent's text and once more by itself.
    """
    t, div, span = "__tokens", M.by_tag("div"), M.by_tag("span")
    # each block of the page once, then the values inside it
    found = M.once(M.with_tokens(df, html_col, t),
                   __date=M.first_text(t, M.by_class("text-gray", "text-100", tag="div")),
                   __seller=M.inside(t, M.by_class("user-info-name")),
                   __crumb=M.inside(t, M.by_class("crumb", "text-medium", "crumb-text", tag="ul")),
                   __title=M.inside(t, M.by_class("product-title-price")),
                   __price=M.inside(t, M.by_class("price-box")),
                   __status=M.inside(t, M.by_class("product-status")),
                   __info=M.inside(t, M.by_class("product-infomation")),
                   __desc=M.inside(t, M.by_id(_DESC))).drop(t)
    raw = {
        ("NgayDangBan",): "array(__date)",
        ("Id_NguoiDangban", "NguoiDangban"): M.let(M.select_one("__seller", M.by_tag("a")), lambda a: (
            f"array(regexp_extract({M.attribute(f'{a}.markup', 'href')}, 'user/\\\\s*(.*)', 1), {M.content('__seller', a)})")),
        ("LoaiBDS", "Tinh", "Huyen", "Xa"): M.picked(M.per_item("__crumb", lambda li: M.first_text(li, span)), 1, 2, 3, 4),
        ("DiaChi",): f"array({M.first_text(M.inside(M.inside('__title', div), div), span)})",
        ("TongGia", "Gia/m2"): M.picked(M.texts("__price", span), 0, 1),
        ("MaTin",): M.picked(M.texts(M.inside("__status", div), span), 1),
        ("DienTich", "ChieuDai", "ChieuRong", "Huong", "PhongNgu", "PhongTam"): M.picked(
            M.per_item("__info", _after_icon), 0, 1, 2, 3, 4, 5),
    }
    names = [n for group in raw for n in group]
    found = M.once(found, __raw=f"concat({', '.join(raw.values())})", __paras=M.texts("__desc", M.by_tag("p", "li"), " "))
    sentences = F.transform("__paras", lambda p: html_unescape(F.rtrim(p)))
    found = found.select(*[F.col(quote(c)) for c in df.columns], "__raw", pre_clean(paragraphs_to_text(sentences)).alias("MoTa"))
    out = _decoded_fields(found, F.col("__raw"), names)
    out = out.select(*[F.col(quote(c)) for c in [*df.columns, *names, "MoTa"]])
    return out.withColumn("Gia/m2", F.coalesce(F.col(quote("Gia/m2")), F.lit(MISSING_PRICE_PER_M2)))


def outbound_links(df: DataFrame, id_col: str, html_col: str = "html", pattern: str = _LISTING_LINK,
                   pos_col: str = "pos", url_col: str = "url") -> DataFrame:
    """H2: one row per link, with its position on the page (page order kept)."""
    links = F.regexp_extract_all(as_col(html_col), F.lit(pattern), 1)
    return df.select(id_col, F.posexplode(links).alias(pos_col, url_col))


def last_page(html_col: str = "html", item_pattern: str = _PAGE_ITEM) -> Column:
    """H3: number in the second-to-last pagination entry (null if absent or not a number)."""
    items = F.regexp_extract_all(as_col(html_col), F.lit(item_pattern), 1)
    return F.when(F.size(items) >= 2, F.element_at(items, -2)).try_cast("int")


def _paired(df: DataFrame, id_col: str, a: Column, b: Column, na: str, nb: str) -> DataFrame:
    """(id, array<struct<na, nb>>) pairing two same-position arrays.

    Each array is computed once per row as a named column and zipped without
    a lambda, so no regular expression is re-run per element.
    """
    return (df.select(id_col, a.alias(na), b.alias(nb))
            .select(id_col, F.arrays_zip(F.col(na), F.col(nb)).alias("pairs")))


def _detail_items(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pairs): key and value of every list item of the details tab, read inside the item, so they cannot drift apart."""
    def pair(li: str) -> str:
        def both(span: str) -> str:
            key = M.first_text(M.inner(li, span), M.by_tag("span"))
            value = M.content(li, M.select_one(li, lambda x: f"{x}.tag = 'span' AND {x}.pos > {span}.end"))
            return f"named_struct('k', coalesce({key}, ''), 'v', coalesce({value}, ''))"
        return M.let(M.select_one(li, M.by_tag("span")), both)

    page = M.with_tokens(df.select(id_col, html_col), html_col, "__tokens")
    tab = M.once(page, __list=M.inside(M.inside("__tokens", M.by_id(_DETAIL)), M.by_tag("ul")))
    return M.once(tab, pairs=M.per_item("__list", pair)).select(id_col, "pairs")


def _last_values(pairs: DataFrame, id_col: str, removed) -> DataFrame:
    """(id, kv): per page its array of (pos, key, value), unique keys in page order."""
    # (key, pos, value) per pair, sorted by key then page position: the last
    # value of a key is the element whose successor has another key.  Sort
    # twice instead of comparing every pair with every later one: O(n log n).
    # key and value of a pair go through ONE decoder expression (a two-element array)
    decoded = F.transform("pairs", lambda x: F.transform(F.array(x["k"], x["v"]), html_unescape))
    by_key = F.sort_array(F.transform(decoded, lambda d, i: F.struct(
        attribute_name(d[0]).alias("key"), i.alias("pos"), squash_whitespace(d[1]).alias("value"))))

    kept = "filter(kv, (x, i) -> NOT get(kv, i + 1).key <=> x.key)"
    if removed:
        kept = f"filter({kept}, x -> x.key NOT IN ({', '.join(map(M.literal, removed))}))"
    keyed = pairs.select(id_col, F.inline(F.array(F.struct(by_key.alias("kv")))))
    return keyed.select(id_col, F.expr(f"sort_array(transform({kept}, x -> named_struct('pos', x.pos, 'key', x.key, 'value', x.value)))").alias("kv"))


def detail_pairs(df: DataFrame, id_col: str, html_col: str = "html", block: str | None = None,
                 key_pattern: str | None = None, value_pattern: str | None = None,
                 removed=REMOVED_DETAIL_KEYS) -> DataFrame:
    """H4: (id, pos, key, value) with keys normalised by F6 and values squashed.

    By default the pairs are the list items of the details tab, with the lists
    nested in it.  On other layouts ``block`` is the pattern of the markup that
    holds them, and each match of the key and value patterns is a pair.

    A key repeated on one page keeps its *last* value and ``removed`` keys are
    dropped.  All pairs of a page live in one row, so de-duplication is an
    array expression inside that row: no shuffle.
    """
    if block is None:
        pairs = _detail_items(df, id_col, html_col)
    else:
        area = _extract(as_col(html_col), block)
        pairs = _paired(df, id_col, F.regexp_extract_all(area, F.lit(key_pattern), 1),
                        F.regexp_extract_all(area, F.lit(value_pattern), 1), "k", "v")
    last = _last_values(pairs, id_col, removed)
    # the outer form: a generator over an array column makes the optimiser infer a filter on the array and
    # repeat the whole extraction inside it
    return (last.select(id_col, F.posexplode_outer("kv").alias("pos", "kv")).where(F.col("pos").isNotNull())
            .select(id_col, F.col("pos").cast("bigint").alias("pos"), "kv.key", "kv.value"))


def details_map(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """H4 wide form: one ``map<string,string>`` per row (keys unique, last wins; empty without details)."""
    return _last_values(_detail_items(df, id_col, html_col), id_col, REMOVED_DETAIL_KEYS).select(id_col, F.map_from_entries(
        F.transform("kv", lambda x: F.struct(x["key"], x["value"]))).alias("details"))


def amenity_groups(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """H5: (id, group, items) — every heading of the amenity tabs that is
    directly followed by an amenity list names that list; item texts are
    read per ``<li>``."""
    is_list = M.by_class("product-other-utilities", tag="ul")

    def group(h: str) -> str:
        follows = M.select_one("__tab", lambda x: f"{x}.pos = {h}.end + 1 AND {is_list(x)}")
        between = f"regexp_replace({M.text_at('__tab', f'{h}.end')}, '\\\\s+', '')"
        return M.let(follows, lambda ul: f"named_struct('h', {M.content('__tab', h)}, 'l', if({between} = '', {M.inner('__tab', ul)}, NULL), "
                                         f"'found', {ul} IS NOT NULL)")

    page = M.with_tokens(df.select(id_col, html_col), html_col, "__tokens")
    tab = M.once(page, __tab=M.inside("__tokens", M.by_class("tabs-product", tag="div"))).drop("__tokens")
    named = M.once(tab, __groups=M.keep(M.each(M.select("__tab", M.by_tag("h2")), group), lambda g: f"{g}.found AND {g}.l IS NOT NULL"))
    texts = M.per_item("g.l", lambda li: f"coalesce({M.first_text(li, M.by_tag('span'))}, '')")
    out = (named.select(id_col, F.explode_outer("__groups").alias("g")).where(F.col("g").isNotNull())
           .select(id_col, "g.h", F.expr(texts).alias("texts")))
    items = F.transform("texts", lambda x: squash_whitespace(html_unescape(x)))
    return out.select(id_col, attribute_name(html_unescape("h")).alias("group"), items.alias("items"))


def nav_links(df: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """H2 on generic pages: (id, pos, href, text) of every anchor."""
    html = as_col(html_col)
    hrefs = F.regexp_extract_all(html, F.lit(GENERIC_NAV_LINK), 1)
    texts = F.regexp_extract_all(html, F.lit(GENERIC_NAV_LINK), 2)
    return (_paired(df, id_col, hrefs, texts, "href", "text")
            .select(id_col, F.posexplode_outer("pairs").alias("pos", "a")).where(F.col("pos").isNotNull())
            .select(id_col, F.col("pos").cast("bigint").alias("pos"), F.col("a.href").alias("href"),
                    html_unescape(F.col("a.text")).alias("text")))
