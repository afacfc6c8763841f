"""Page extraction (H1–H6) on own listing-layout HTML."""

from plotline.operators import markup as M
from plotline.operators import pages as PG
from tests.pages_fixtures import INDEX_PAGE, LISTING_PAGE, NO_PRICE_PER_M2_PAGE


def pages(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "page_id long, html string")


def test_listing_fields(spark):
    r = PG.listing_fields(pages(spark, LISTING_PAGE), "html").collect()[0]
    assert r.NgayDangBan == "01/07/2022, 09:15"
    assert r.Id_NguoiDangban == "4242" and r.NguoiDangban == "Anh Minh"
    assert (r.LoaiBDS, r.Tinh, r.Huyen, r.Xa) == ("Nhà riêng", "TP. Trung Tâm", "Quận 3", "Phường 7")
    assert r.DiaChi == "12 Đường Số 5"
    assert r.TongGia == "5.2 tỷ" and r["Gia/m2"] == "104 triệu/m²" and r.MaTin == "88123"
    assert (r.DienTich, r.ChieuDai, r.ChieuRong, r.Huong, r.PhongNgu, r.PhongTam) == \
        ("50 m²", "10 m", "5 m", "Đông Nam", "3", "2")
    assert r.MoTa == "Nhà mới xây đẹp. Gần chợ. Sổ 'đỏ'."          # H6: periods, nbsp, quotes


def test_missing_price_per_m2_is_sentinel(spark):
    r = PG.listing_fields(pages(spark, NO_PRICE_PER_M2_PAGE), "html").collect()[0]
    assert r["Gia/m2"] == "--" and r.MaTin == "88124"


def test_detail_pairs_last_wins_and_removed_key(spark):
    out = PG.detail_pairs(pages(spark, LISTING_PAGE), "page_id", "html").collect()
    got = {r.key: r.value for r in out}
    assert got == {"NamXayDung": "2020", "HuongBanCong": "Tây Bắc"}
    m = PG.details_map(pages(spark, LISTING_PAGE), "page_id", "html").collect()[0].details
    assert m == got


def test_amenity_groups(spark):
    out = {r.group: r["items"] for r in PG.amenity_groups(pages(spark, LISTING_PAGE), "page_id").collect()}
    assert out == {"TienIchToaNha": ["Thang máy", "Hồ bơi"], "AnNinh": ["Camera"]}


def test_links_and_last_page(spark):
    df = pages(spark, INDEX_PAGE)
    links = PG.outbound_links(df, "page_id").orderBy("pos").collect()
    assert [(r.pos, r.url[-10:]) for r in links] == [(0, "1100000101"), (1, "1100000102"), (2, "1100000103")]
    assert df.select(PG.last_page("html").alias("n")).collect()[0].n == 37
    assert pages(spark, "<html></html>").select(PG.last_page("html").alias("n")).collect()[0].n is None


def test_generic_page_fields(spark):
    html = ('<html lang="vi"><head><title>Tiêu  đề &amp; x</title></head><body><nav><a href="/a">A</a></nav>'
            '<div class="ad">QC</div><article><h1>H</h1><p><b>Một<br><p>Hai.</p><p>Ba &quot;c&quot;</p></article>'
            '</body></html>')
    r = PG.page_fields(pages(spark, html), "html").collect()[0]
    assert (r.lang, r.title, r.h1, r.ad, r.n_paragraphs) == ("vi", "Tiêu đề & x", "H", "QC", 3)
    assert r.description == "Một. Hai. Ba 'c'."
    nav = PG.nav_links(pages(spark, html), "page_id").collect()
    assert [(r.pos, r.href, r.text) for r in nav] == [(0, "/a", "A")]


def test_irregular_listing_markup(spark):
    page = (LISTING_PAGE
            .replace('<li><a href="/"><span>Trang chủ</span></a></li>',
                     '<li><a href="/"><i class="icon-home"></i></a></li>')          # item without a span
            .replace("<span>Tây   Bắc</span>", "<span>Tây&nbsp;Bắc&nbsp;</span>")    # no-break spaces
            .replace("</body>", "<h2>Tin liên quan</h2><ul><li><span>x</span></li></ul></body>"))
    r = PG.listing_fields(pages(spark, page), "html").collect()[0]
    assert (r.LoaiBDS, r.Tinh, r.Huyen, r.Xa) == ("Nhà riêng", "TP. Trung Tâm", "Quận 3", "Phường 7")
    got = {x.key: x.value for x in PG.detail_pairs(pages(spark, page), "page_id", "html").collect()}
    assert got["HuongBanCong"] == "Tây Bắc"
    groups = {x.group for x in PG.amenity_groups(pages(spark, page), "page_id").collect()}
    assert groups == {"TienIchToaNha", "AnNinh"}                                       # no trailing heading


def test_seller_id_takes_first_user_segment(spark):
    page = LISTING_PAGE.replace("https://nha.example.vn/user/ 4242", "https://nha.example.vn/user/a/user/b")
    r = PG.listing_fields(pages(spark, page), "html").collect()[0]
    assert r.Id_NguoiDangban == "a/user/b"


def test_classes_match_among_others(spark):
    page = (LISTING_PAGE.replace('class="product-infomation"', 'class="row product-infomation"')
            .replace('class="text-gray text-100"', 'class="text-100 small text-gray"')
            .replace('class="price-box"', 'class="price-box big"')
            .replace('class="product-other-utilities"', 'class="x product-other-utilities y"')
            .replace("<ul class=\"crumb text-medium crumb-text\"", "<ul id=\"c\" class=\"crumb-text crumb text-medium\""))
    one = PG.listing_fields(pages(spark, page), "html").collect()[0]
    assert one[2:] == PG.listing_fields(pages(spark, LISTING_PAGE), "html").collect()[0][2:]   # all but id and html
    assert {g.group for g in PG.amenity_groups(pages(spark, page), "page_id").collect()} == {"TienIchToaNha", "AnNinh"}
    other = LISTING_PAGE.replace('class="product-infomation"', 'class="product-infomation-old"')
    assert PG.listing_fields(pages(spark, other), "html").collect()[0].DienTich is None


def test_paragraph_text_runs_through_inner_tags(spark):
    html = ('<article><p class="a">Hello <a href="/x">link</a> tail.</p><pre>code</pre><p>Open <b>bold</b>'
            '<p>Next</article>')
    r = PG.page_fields(pages(spark, html), "html").collect()[0]
    assert r.n_paragraphs == 3 and r.description == "Hello link tail. Open bold. Next."


def test_details_map_keeps_repeated_page_ids_apart(spark):
    twice = spark.createDataFrame([(1, LISTING_PAGE), (1, LISTING_PAGE.replace("2020", "2021")), (2, "")],
                                  "page_id long, html string")
    out = PG.details_map(twice, "page_id")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.page_id, r.details.get("NamXayDung")) for r in out.collect() if r.details) == [(1, "2020"), (1, "2021")]


def test_blocks_run_to_their_own_end_tag(spark):
    page = (LISTING_PAGE
            .replace("<p>Nhà mới", "<div class='ad'><div>x</div></div><p>Nhà mới")
            .replace("<li>Gần chợ</li>", "<li>Gần <b>chợ</b></li><li><div>Có sân</div></li>")
            .replace('<div class="price-box"><span>', '<div class="price-box"><div><b></b></div><span>')
            .replace('<div class="product-status"><div>', '<div class="product-status"><div><div></div>')
            .replace("<span>120 m²</span></li>", "<span>120 m²</span><ul><li>a</li></ul></li>")
            .replace("<li><span>Thang máy</span></li>", "<li><span>Thang máy</span><ul><li><span>Kính</span></li></ul></li>"))
    one = PG.listing_fields(pages(spark, page), "html").collect()[0]
    assert (one.TongGia, one["Gia/m2"], one.MaTin) == ("5.2 tỷ", "104 triệu/m²", "88123")
    assert one.MoTa == "Nhà mới xây đẹp. Gần chợ. Có sân. Sổ 'đỏ'."
    got = {r.key: r.value for r in PG.detail_pairs(pages(spark, page), "page_id").where("key <> ''").collect()}
    assert got == {"NamXayDung": "2020", "HuongBanCong": "Tây Bắc"}
    groups = {r.group: r["items"] for r in PG.amenity_groups(pages(spark, page), "page_id").collect()}
    assert groups == {"TienIchToaNha": ["Thang máy", "Kính", "Hồ bơi"], "AnNinh": ["Camera"]}


def test_unclosed_block_runs_to_the_end(spark):
    page = '<div id="content-tab-custom"><div><p>Một</p></div><p>Hai'
    assert PG.listing_fields(pages(spark, page), "html").collect()[0].MoTa == "Một. Hai."


def test_token_table(spark):
    from plotline.operators import markup as M
    html = '<!-- <p> --><p>a<br>b</p>\n<DIV class="x  y"><div id=q>t</div>u<p>z</DIV> tail<script>var t="</div>";</script>1 < 2<img alt="a>b"/>'
    toks = M.with_tokens(pages(spark, html)).selectExpr("inline(tokens)").collect()
    got = [(t.tag, t.kind, t.end, t.classes.split(), t.id, t.text) for t in toks]
    assert got == [("", 0, None, [], "", ""), ("p", 1, 3, [], "", "a"), ("br", 0, None, [], "", "b"), ("p", -1, None, [], "", "\n"),
                   ("div", 1, 8, ["x", "y"], "", ""), ("div", 1, 6, [], "q", "t"), ("div", -1, None, [], "", "u"), ("p", 1, None, [], "", "z"),
                   ("div", -1, None, [], "", " tail"), ("script", 0, None, [], "", "1 < 2"), ("img", 0, None, [], "", "")]
    assert [t.depth for t in toks if t.tag == "div"] == [1, 2, 2, 1]


def test_end_tags_match_over_many_chunks(spark):
    import random
    from plotline.operators import markup as M
    rng = random.Random(1)
    parts, open_, want = [], [], {}
    for i in range(700):
        if open_ and rng.random() < 0.5:
            tag, start = open_.pop()
            want[start] = i
            parts.append(f"</{tag}>")
        else:
            tag = rng.choice(["div", "ul", "span"])
            open_.append((tag, i))
            want[i] = None
            parts.append(f"<{tag}>")
    toks = M.with_tokens(pages(spark, "".join(parts), "", None)).selectExpr("page_id", "inline_outer(tokens)").collect()
    assert {t.pos: t.end for t in toks if t.page_id == 0 and t.kind == 1} == want


def test_nested_items_belong_to_their_parent(spark):
    page = '<div id="content-tab-custom"><ul><li>Có <ul><li>sân</li><li>ao.</li></ul></li><li>Gần chợ</li></ul></div>'
    assert PG.listing_fields(pages(spark, page), "html").collect()[0].MoTa == "Có sânao. sân. ao. Gần chợ."


def test_extraction_stands_once_in_the_plan(spark):
    for df in (PG.listing_fields(pages(spark, LISTING_PAGE), "html"), PG.detail_pairs(pages(spark, LISTING_PAGE), "page_id"),
               PG.amenity_groups(pages(spark, LISTING_PAGE), "page_id")):
        plan = df.where("page_id >= 0")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("<!--.*?") == 2                  # the two groups of the one tokeniser


def test_lookups_neither_copy_nor_scan(spark):
    """a value is handed on without a copy, and the tokens inside an element are cut out, not filtered."""
    assert "transform" not in M.let("v", lambda v: f"{v} + 1")
    assert M.inner("toks", "e").count("filter(") == 1          # for an element without an own end tag only
    page = "<ul><li>a<b>c</b></li><li><i>d</ul>e<p>f</b>g"
    df = M.with_tokens(spark.createDataFrame([(page,), (None,), ("",)], "html string"))
    li = M.per_item("tokens", lambda x: M.content(x, f"get({x}, 0)"))
    out = df.selectExpr(f"{M.texts('tokens', M.by_tag('li'))} AS items", f"{M.first_text('tokens', M.by_tag('p'))} AS last",
                        f"{M.text_at(M.inside('tokens', M.by_tag('ul')), '2')} AS third", f"coalesce(size({li}), -1) AS n").collect()
    assert [tuple(r) for r in out] == [(["ac", "d"], "fg", "c", 2), (None, None, None, -1), ([], None, None, 0)]
