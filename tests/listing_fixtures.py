"""Hand-written synthetic listings (own data, listing schema of the crawler)."""

from pyspark.sql import types as T

from plotline.schema import raw_listing_schema

_BASE = {
    "MaTin": "1001", "NgayDangBan": "01/07/2022, 09:15", "Id_NguoiDangban": "77", "NguoiDangban": "Chị Lan",
    "LoaiBDS": "Nhà riêng", "Tinh": "TP. Trung Tâm", "Huyen": "Quận Cầu Giấy", "Xa": "Phường Dịch Vọng",
    "DiaChi": "Ngõ 12", "MoTa": "Nhà đẹp.", "TongGia": "5.2 tỷ", "Gia/m2": "104 triệu/m²",
    "DienTich": "50 m²", "DienTichDat": "52 m²", "ChieuDai": "10 m", "ChieuRong": "5 m",
    "ChieuSau": "10 m", "DuongVao": "4 m", "NamXayDung": "2019", "Huong": "Đông", "PhongNgu": "3",
    "PhongTam": "2", "SoTang": "4", "GiayToPhapLy": "Sổ đỏ", "ViTri": "Ngõ", "HienTrangNha": "Mới",
    "TrangThaiSuDung": "Đang ở", "HuongBanCong": "--", "KetCau": "Bê tông",
    "TienIchToaNha": ["Thang máy", "Bảo vệ."], "TienIchLanCan": ["Chợ", "Trường học", "Chợ"],
    "NoiThat,TienNghi": None, "HangXom": [], "AnNinh": ["Camera"], "DuongVaoBds": ["Ô tô"],
    "TienIchGanDat": None, "id": 1100000101,
}


def listing(**over):
    r = dict(_BASE)
    r.update(over)
    return r


def listings():
    return [
        listing(),
        listing(MaTin="1002", TongGia="850 triệu", DienTich="--", DienTichDat="40 m²", NamXayDung="2021.0",
                ChieuDai=None, PhongNgu=None, SoTang="", Huong="", Id_NguoiDangban="77",
                Tinh="Tỉnh Một", Huyen="Huyện Ba Bể", Xa="Xã Cao Thượng", TienIchToaNha=None),
        listing(MaTin="1003", TongGia="Thỏa thuận", NamXayDung=None, DuongVao="--", Id_NguoiDangban="78",
                Tinh="Tỉnh Hai", Huyen="Thị xã Quảng Uyên", Xa="Thị trấn Tà Lùng", TienIchLanCan=["Chợ."]),
        listing(MaTin="1004", TongGia="950 nghìn", NamXayDung="2019", ChieuRong="m", Id_NguoiDangban=None,
                Tinh="Không có", Huyen="Khu A", Xa="Ấp 2", KetCau=None),
        listing(MaTin=None, TongGia="3 tỷ"),
        listing(MaTin="1006", NgayDangBan="--", TongGia="2 tỷ"),
        listing(MaTin="1007", TongGia="1.1 tỷ", NamXayDung="2021", Id_NguoiDangban="79",
                Tinh="TP. Trung Tâm", Huyen="TP. Thủ Đức", Xa="Phường 5"),
    ]


def listing_df(spark, rows=None):
    return spark.createDataFrame(rows or listings(), raw_listing_schema())


TIERS = [("TP. Trung Tâm", "Đặc biệt"), ("Tỉnh Một", "III"), ("Tỉnh Hai", "II"), ("Tỉnh Ba", "I")]
TIER_SCHEMA = T.StructType([T.StructField("Tinh", T.StringType()), T.StructField("PhanLoaiTinh", T.StringType())])
