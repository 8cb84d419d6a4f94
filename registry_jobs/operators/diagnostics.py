"""Diagnostic lines about a text, its record and where values come from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.predicates import count_history_noise
from registry_jobs.functions.quality import js_round
from registry_jobs.functions.text import compact


def _t(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


def _or(value: Column, otherwise: str) -> Column:
    return F.when(value != "", value).otherwise(otherwise)


def _n(x: Column) -> Column:
    return x.cast("string")


# The sentences of the summary.
def structure_summary(text: Column, f: Column) -> Column:
    """Sections that the text seems to hold, counts, diagnostics, noise lines and export values."""
    c = compact(F.coalesce(text, F.lit("")))
    yes = lambda p, no: F.when(c.rlike(p), "あり").otherwise(no)
    none = "空欄"
    return F.concat(
        F.array(
            _t("表題部候補: ", yes(P.TITLE_START, "未確認")),
            _t("甲区候補: ", yes("甲区|所有権移転|所有権一部移転|持分一部移転", "未確認")),
            _t("乙区除外候補: ", yes("乙区|抵当権", "なし")),
            _t("共同担保除外候補: ", yes("共同担保|担保目録", "なし")),
            _t("ownersHistory有効件数: ", _n(F.size(f["history"])), "件"),
            _t("甲区所有関係診断: ", _n(F.size(f["ownership_diagnostics"])), "件"),
        ),
        f["ownership_diagnostics"],
        F.array(_t("Title/field diagnostics: ", _n(F.size(f["field_diagnostics"])), " items")),
        f["field_diagnostics"],
        F.array(
            _t("ownersHistoryノイズ除外目安: ", _n(count_history_noise(text)), "行"),
            _t("最新所有者: ", F.when(f["owner"] != "", "確定候補あり").otherwise("未検出（最新有効エントリの人名/法人名根拠不足）")),
            _t("CSV/Excel確定値: owner=", _or(f["owner"], none), " / location=", _or(f["location"], none), " / number=", _or(f["lot_number"], none), " / area=", _or(f["land_area"], none), " / buildingArea=", _or(f["building_area"], none)),
        ),
    )


# Field, its label, the ground of an accepted value, and why none was.
REASONS = (
    ("location", "location", "表題部所在の確定候補", "未検出（表題部所在なし、所有者住所/担保目録/OCRノイズ由来の候補を却下）"),
    ("lot_number", "number", "地番ラベル近傍の確定候補", "未検出（住所内番地、共有者住所、または地番ラベル根拠なしの番号を却下）"),
    ("land_area", "area", "地積ラベル近傍の確定候補", "未検出（地積ラベル近傍ではない面積値を却下）"),
    ("building_area", "buildingArea", "床面積/建物面積ラベル近傍の確定候補", "未検出（床面積/建物面積ラベル近傍ではない値を却下）"),
    ("owner", "owner", "甲区の最新有効エントリ由来の確定候補", "未検出（見出し語、原因文、住所、日付混入、またはOCRノイズ混じり候補を却下）"),
)


def field_reasons(f: Column, sources: Column) -> Column:
    """One line a field; sources: map of field to the label of its reading."""
    lines = []
    for name, label, ground, none in REASONS:
        source = F.try_element_at(sources, F.lit(name))
        lines.append(_t(f"{label}: ", F.when(f[name] != "", _t(f[name], f"（{ground}", F.when(source != "", _t(" / 採用元: ", source)).otherwise(""), "）")).otherwise(none)))
    return F.array(*lines, _t("history: ", _n(F.size(f["history"])), "件（甲区所有権事項を優先）"))


def extracted_summary(f: Column) -> Column:
    none = P.NOT_DETECTED
    found = _t("location: ", _or(f["location"], none), " / number: ", _or(f["lot_number"], none), " / owner: ", _or(f["owner"], none), " / history: ", _n(F.size(f["history"])), "件")
    return F.when(f.isNull(), "抽出: 未実行").otherwise(found)


def read_meta(label: Column, quality: Column) -> Column:
    return _t("読み取り方法: ", label, " / 品質スコア: ", _n(js_round(quality["score"])))
