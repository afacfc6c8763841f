"""Column roles of a listing table.

Operators never hard-code column names: they take a ``ListingColumns`` (or
plain names) so the same code runs on listing data and on any other table.
The defaults below are the field names of the crawled listing records.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

# --- fixed values: listing field names and their roles ---------------------
# identifier: MaTin
# post date: NgayDangBan
# label (total price): TongGia
# price per m2: Gia/m2
# area, land area: DienTich, DienTichDat
# lengths: ChieuDai, ChieuRong, ChieuSau, DuongVao
# construction year: NamXayDung
# array (amenity) columns: TienIchToaNha, TienIchLanCan, "NoiThat,TienNghi",
#   HangXom, AnNinh, DuongVaoBds, TienIchGanDat
# categorical columns: Id_NguoiDangban, LoaiBDS, Tinh, Xa, Huyen, Huong,
#   PhongNgu, PhongTam, GiayToPhapLy, SoTang, ViTri, HienTrangNha,
#   TrangThaiSuDung, HuongBanCong, KetCau
# constant fills: PhongNgu '0', PhongTam '0', SoTang '1', other categoricals 'Unknowns'
# columns dropped after cleaning: DienTichDat, ChieuSau
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class ListingColumns:
    identifier: str = "MaTin"
    post_date: str = "NgayDangBan"
    label: str = "TongGia"
    price_per_m2: str = "Gia/m2"
    area: str = "DienTich"
    land_area: str = "DienTichDat"
    lengths: tuple[str, ...] = ("ChieuDai", "ChieuRong", "ChieuSau", "DuongVao")
    year: str = "NamXayDung"
    arrays: tuple[str, ...] = (
        "TienIchToaNha", "TienIchLanCan", "NoiThat,TienNghi", "HangXom",
        "AnNinh", "DuongVaoBds", "TienIchGanDat",
    )
    categoricals: tuple[str, ...] = (
        "Id_NguoiDangban", "LoaiBDS", "Tinh", "Xa", "Huyen", "Huong", "PhongNgu",
        "PhongTam", "GiayToPhapLy", "SoTang", "ViTri", "HienTrangNha",
        "TrangThaiSuDung", "HuongBanCong", "KetCau",
    )
    seller: str = "Id_NguoiDangban"
    province: str = "Tinh"
    district: str = "Huyen"
    ward: str = "Xa"
    # columns whose nulls are filled with the mean / mode of the training data
    mean_filled: tuple[str, ...] = ("ChieuDai", "ChieuRong", "DuongVao", "DienTich")
    mode_filled: tuple[str, ...] = ("NamXayDung",)
    constant_fills: dict = field(default_factory=lambda: {
        "PhongNgu": "0", "PhongTam": "0", "SoTang": "1"})
    default_category: str = "Unknowns"
    dropped_after_clean: tuple[str, ...] = ("DienTichDat", "ChieuSau")
    # categoricals that get their own ordinal encoders instead of an index
    administrative: tuple[str, ...] = ("Tinh", "Huyen", "Xa")

    @property
    def continuous(self) -> tuple[str, ...]:
        return (self.label, self.price_per_m2, self.area, self.land_area,
                *self.lengths, self.year)

    @property
    def float_columns(self) -> tuple[str, ...]:
        return tuple(c for c in self.continuous
                     if c != self.year and c not in self.dropped_after_clean)

    @property
    def indexed_categoricals(self) -> tuple[str, ...]:
        """Categoricals encoded by a frequency index (seller and places excluded)."""
        skip = set(self.administrative) | {self.seller}
        return tuple(c for c in self.categoricals if c not in skip)

    def with_(self, **kw) -> "ListingColumns":
        return replace(self, **kw)


DEFAULT = ListingColumns()


def raw_listing_schema(cols: ListingColumns = DEFAULT) -> T.StructType:
    """Explicit read schema for raw listing JSON (no inference pass)."""
    string_fields = [cols.identifier, cols.post_date, "NguoiDangban", "DiaChi", "MoTa",
                     *cols.continuous, *cols.categoricals]
    seen, fields = set(), []
    for name in string_fields:
        if name not in seen:
            seen.add(name)
            fields.append(T.StructField(name, T.StringType(), True))
    fields += [T.StructField(a, T.ArrayType(T.StringType(), True), True) for a in cols.arrays]
    fields.append(T.StructField("id", T.LongType(), True))
    return T.StructType(fields)
