"""Scalar column functions (F1–F17, P6) and traps G1, G2, G6, G11, G14."""

import pytest
from pyspark.sql import functions as F

from plotline import functions as PF
from plotline.functions.text import accent_fold_map


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"v {dtype}")
    return df.select(expr(F.col("v")).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("text,expected", [
    ("2.5 tỷ", 2500.0), ("850 triệu", 850.0), ("950 nghìn", 0.95), ("1234 nghìn", 1.234),
    ("12 USD", None),          # unknown unit -> null (G1)
    ("3500", None),            # one token -> null instead of an index error (G1)
    ("Thỏa thuận", None),      # text -> null
    ("1,5 tỷ", None),          # comma decimal does not parse
    (None, None),
])
def test_price_to_millions(spark, text, expected):
    got = one(spark, PF.price_to_millions, text)
    assert got == pytest.approx(expected) if expected is not None else got is None


@pytest.mark.parametrize("text,expected", [
    ("45 triệu/m²", 45.0), ("0.1 tỷ/m²", 100.0), ("800 nghìn/m²", 0.8), ("--", None), ("5 triệu", None),
])
def test_price_per_m2(spark, text, expected):
    got = one(spark, PF.price_per_m2_to_millions, text)
    assert got == pytest.approx(expected) if expected is not None else got is None


def test_suffixes_and_short_text(spark):
    assert one(spark, PF.area_number, "52 m²") == "52"
    assert one(spark, PF.length_number, "4.5 m") == "4.5"
    assert one(spark, PF.area_number, "m²") == ""          # shorter than the suffix -> '' (G14)
    assert one(spark, lambda c: PF.try_double(PF.area_number(c)), "m") is None
    assert one(spark, PF.area_number, None) is None


def test_try_int_accepts_decimal_year(spark):
    assert one(spark, PF.try_int, "2021.0") == 2021
    assert one(spark, PF.try_int, "2019") == 2019
    assert one(spark, PF.try_int, "không rõ") is None      # never raises under ANSI (G6)


def test_pre_clean(spark):
    text = 'Nhà  đẹp, "mới"   xây \\'
    assert one(spark, PF.pre_clean, text) == "Nhà đẹp, 'mới' xây \\."


def test_attribute_name(spark):
    assert one(spark, PF.attribute_name, "diện tích đất") == "DienTichDat"
    assert one(spark, PF.attribute_name, "  Hướng   ban công ") == "HuongBanCong"
    assert one(spark, PF.attribute_name, "Straße éCOLE") == "StrasseEcole"
    assert one(spark, PF.attribute_name, "Đường vào") == "DuongVao"


def test_accent_map_is_one_to_one():
    src, dst = accent_fold_map()
    assert len(src) == len(dst) and len(set(src)) == len(src)
    assert dict(zip(src, dst))["ệ"] == "e" and dict(zip(src, dst))["Ố"] == "O"


def test_url_predicates(spark):
    ok = ["https://nha.example.vn/ban-nha-1100000101", "http://localhost:8080/x", "ftp://10.0.0.1/a",
          "HTTPS://EXAMPLE.COM"]
    bad = ["htp://example.com", "https:/example.com", "http://exa mple.com", "", None]
    for u in ok:
        assert one(spark, PF.is_valid_url, u) is True, u
    for u in bad:
        assert one(spark, PF.is_valid_url, u) is False, u
    assert one(spark, PF.url_id, "https://nha.example.vn/ban-nha-1100000101") == "1100000101"


def test_text_helpers(spark):
    assert one(spark, PF.strip_dots, "Hồ bơi.") == "Hồ bơi"
    assert one(spark, lambda c: PF.seller_id_from_profile(c), "https://x.vn/user/ 12345") == "12345"
    assert one(spark, lambda c: PF.extract_group(c, r"\"(Mr)\"", 1), 'Braund, "Mr" Owen') == "Mr"
    assert one(spark, lambda c: PF.extract_group(c, r"\"(Mr)\"", 1), "Miss Laina") == ""
    assert one(spark, PF.squash_whitespace, "  a \t b\n\nc ") == "a b c"
    arr = spark.createDataFrame([(["Một", "Hai.", ""],)], "v array<string>")
    assert arr.select(PF.paragraphs_to_text("v")).collect()[0][0] == "Một. Hai. ."


def test_page_urls(spark):
    df = spark.createDataFrame([("https://x.vn/ban", 3)], "base string, last int")
    urls = df.select(F.explode(PF.page_numbers(F.lit(1), F.col("last"))).alias("p"), "base") \
        .select(PF.page_url("base", "p").alias("u")).collect()
    assert [r.u for r in urls] == ["https://x.vn/ban?page=1", "https://x.vn/ban?page=2", "https://x.vn/ban?page=3"]


def test_ordinals_order_matters(spark):
    from plotline.operators.encode import TIER_RULES
    f = lambda c: PF.ordinal_by_keywords(c, TIER_RULES, lower=False)
    assert one(spark, f, "Đặc biệt") == 4
    assert one(spark, f, "III") == 3      # 'III' contains 'II' and 'I' (G11)
    assert one(spark, f, "II") == 2
    assert one(spark, f, "I") == 1
    assert one(spark, f, "x") is None


def test_money_text_and_clock(spark):
    assert one(spark, PF.money_text, 1234.5678, "double") == "1,234,568"
    row = spark.range(1).select(PF.current_time("Asia/Ho_Chi_Minh").alias("t")).collect()[0]
    assert row.t is not None
    assert one(spark, PF.exp_back, 0.0, "double") == pytest.approx(1.0)


def test_html_unescape_all_references(spark):
    text = "d&agrave;i &#7879; &#x1EC7; &amp;lt; &apos;x&apos; &bogus; 5&amp;&amp;"
    assert one(spark, PF.html_unescape, text) == "dài ệ ệ &lt; 'x' &bogus; 5&&"
    assert one(spark, PF.html_unescape, "no refs") == "no refs"


def test_folding_decomposed_input_and_superscripts(spark):
    import unicodedata
    nfd = unicodedata.normalize("NFD", "Diện tích")
    assert one(spark, PF.attribute_name, nfd) == "DienTich"
    assert one(spark, PF.attribute_name, "50 m²") == "50M2"


def test_clock_does_not_depend_on_session_zone(spark):
    import datetime as dt
    from zoneinfo import ZoneInfo
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = spark.range(1).select(PF.current_time("Asia/Ho_Chi_Minh").alias("t")).collect()[0].t
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    want = dt.datetime.now(ZoneInfo("Asia/Ho_Chi_Minh")).replace(tzinfo=None)
    assert abs((got - want).total_seconds()) < 120


def test_money_text_rounds_half_to_even(spark):
    assert one(spark, PF.money_text, 2.5005, "double") == "2,500"       # 2500.5 -> 2500, as Python round
    assert one(spark, PF.money_text, 2.5015, "double") == "2,502"


@pytest.mark.parametrize("text", [
    "smile &#55357;&#56832; &#128512;",          # surrogate halves must not abort the job
    "a &#38;lt; b &lt; c", "&#38;amp;",           # decoded output is never decoded again
    "dash &#150; nul &#0; big &#1114112;",        # HTML's numeric rules
    "d&agrave;i &#7879; &#x1EC7; &apos;x&apos; &bogus; 5&amp;&amp;", "lone & amp",
])
def test_html_unescape_matches_python(spark, text):
    import html
    assert one(spark, PF.html_unescape, text) == html.unescape(text)


def test_html_unescape_equals_the_standard_library(spark):
    import html
    import random
    from html.entities import html5
    rng = random.Random(3)
    texts = ["&copy 2024", "&amp nbsp", "&#00000065;", "&check;", "&#65 x", "a &lt b", "&#x0000041;", "&notit;", "&notin;", "&amp;amp;", "&#",
             "&#xg", "&;", "&#55555555555555555555;", "&#x80;", "&#129;", "&#1;", "&#xFFFE;", "&#xD800;", "&#128512;", "&ampx", "&fjlig;",
             "&CounterClockwiseContourIntegralx;", "&" + "a" * 50 + ";", "&" + "amp" * 20, None]
    texts += [f"x&{n}" for n in html5] + ["&" + n.rstrip(";") + "y" for n in html5]
    texts += ["".join(rng.choice(["&", "#", "x", "X", "a", "m", "p", ";", "1", "0", "6", " ", "lt", "not", "copy", "é", "f"])
                      for _ in range(rng.randint(1, 14))) for _ in range(1500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(8)
    got = df.select("t", PF.html_unescape("t").alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.u != (html.unescape(r.t) if r.t is not None else None)] == []


def test_transliteration_of_known_words(spark):
    expected = {"Москва": "Moskva", "Чайковский": "Chaikovskii", "Ελλάδα": "Ellada", "Θήβα": "Theba", "Щука": "Shchuka",
                "한국": "hangug", "さくら": "sakura", "カメラ": "kamera", "שלום": "shlvm", "٤٢": "42", "“a” – ‘b’…": "\"a\" - 'b'...",
                "№ 5 €": "No 5 EUR", "ﬁne": "fine", "Ａ１": "A1", "漢字": "漢字", "": "", "plain": "plain"}
    df = spark.createDataFrame([(k,) for k in expected], "t string")
    got = {r.t: r.f for r in df.select("t", PF.fold_accents("t").alias("f")).collect()}
    assert got == expected
    assert one(spark, PF.attribute_name, "площадь дома") == "Ploshchad'Doma"
    assert one(spark, PF.fold_accents, None) is None


def test_transliteration_equals_its_rule_on_every_character(spark):
    """All characters up to U+FFFF but surrogates, each between two letters; the rule is applied in plain Python."""
    from plotline.functions.transliterate import TABLE_RANGES, ascii_form, transliterate
    chars = [chr(cp) for cp in range(1, 0x10000) if not 0xD800 <= cp <= 0xDFFF] + ["\U0001f600", "\U00020000"]

    def rule(ch):
        inside = any(lo <= ord(ch) <= hi for lo, hi in TABLE_RANGES)
        form = ascii_form(ch) if inside else None
        return ch if form is None else form
    df = spark.createDataFrame([(c, f"x{c}y") for c in chars], "c string, t string")
    bad = [(r.c, r.f) for r in df.select("c", transliterate(F.col("t")).alias("f")).collect() if r.f != f"x{rule(r.c)}y"]
    assert not bad, bad[:10]
    # every letter of the alphabets named gets a form in ASCII
    letters = "".join(map(chr, [*range(0x3B1, 0x3CA), *range(0x410, 0x450), *range(0x561, 0x587), *range(0x10D0, 0x10F1),
                                *range(0x5D0, 0x5EB), *range(0x628, 0x63B), *range(0x3042, 0x3094)]))
    assert all(ascii_form(c) is not None and ascii_form(c).isascii() for c in letters)
