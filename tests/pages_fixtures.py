"""Hand-written listing-layout pages (own invented content)."""

LISTING_PAGE = """<html><head><script>var t="</p>";</script></head><body>
<div class="text-gray text-100"> 01/07/2022, 09:15 </div>
<div class="user-info-name"><a href="https://nha.example.vn/user/ 4242">  Anh   Minh </a></div>
<ul class="crumb text-medium crumb-text">
  <li><a href="/"><span>Trang chủ</span></a></li>
  <li><a href="/nha"><span> Nhà riêng </span></a></li>
  <li><a><span>TP. Trung Tâm</span></a></li>
  <li><a><span>Quận 3</span></a></li>
  <li><a><span>Phường 7</span></a></li>
</ul>
<div class="product-title-price"><div><div><span> 12 Đường Số 5 </span></div>
<div><div class="price-box"><span>5.2 tỷ</span><span>104 triệu/m²</span></div>
<div class="product-status"><div><span>Mã tin</span><span>88123</span></div></div></div></div></div>
<ul class="product-infomation">
<li><span><i class="icon-area"></i> 50 m²</span></li>
<li><span><i class="icon-l"></i> 10 m</span></li>
<li><span><i class="icon-w"></i> 5 m</span></li>
<li><span><i class="icon-d"></i> Đông Nam</span></li>
<li><span><i class="icon-b"></i> 3</span></li>
<li><span><i class="icon-t"></i> 2</span></li>
</ul>
<div id="content-tab-custom"><p>Nhà mới&nbsp;xây<br>đẹp</p><ul><li>Gần chợ</li><li>Sổ "đỏ".</li></ul></div>
<div id="content-tab-info"><div><div><ul>
<li><span><span>Diện tích sử dụng</span></span><span>120 m²</span></li>
<li><span><span>Năm xây dựng</span></span><span> 2019 </span></li>
<li><span><span>Hướng ban công</span></span><span>Tây   Bắc</span></li>
<li><span><span>Năm xây dựng</span></span><span>2020</span></li>
</ul></div></div></div>
<div class="tabs-product"><h2>Mô tả</h2><h2>Thông tin</h2>
<h2>Tiện ích tòa nhà</h2><ul class="product-other-utilities"><li><span>Thang máy</span></li><li><span>Hồ bơi</span></li></ul>
<h2>An ninh</h2><ul class="product-other-utilities"><li><span>Camera</span></li></ul></div>
</body></html>"""

NO_PRICE_PER_M2_PAGE = LISTING_PAGE.replace("<span>104 triệu/m²</span>", "").replace("88123", "88124")

INDEX_PAGE = """<html><body>
<p class="name-product"><a href="https://nha.example.vn/ban-nha-a-1100000101">A</a></p>
<p class="name-product"> <a href="https://nha.example.vn/ban-dat-b-1100000102">B</a></p>
<p class="other"><a href="https://nha.example.vn/quang-cao">ad</a></p>
<p class="name-product"><a href="https://nha.example.vn/can-ho-c-1100000103">C</a></p>
<ul class="pagination"><li class="page-item"><a>1</a></li><li class="page-item active"><a>2</a></li>
<li class="page-item"><a>37</a></li><li class="page-item"><a>›</a></li></ul>
</body></html>"""
