"""Fields of the title section."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.marks import first_marked
from registry_jobs.functions.predicates import is_plausible, safe_area, safe_location, safe_number
from registry_jobs.functions.text import clean_value, let
from registry_jobs.operators.sections import first_line_index

def empty() -> Column:
    return F.lit("")


def first_of(values: Column) -> Column:
    """The first value that isn't empty, else empty."""
    return F.coalesce(F.get(F.filter(values, lambda x: x != ""), F.lit(0)), empty())


def first_made(values: list[Column]) -> Column:
    """first_of() of values, each made only where those before are empty."""
    value, *rest = values
    return let(value, lambda v: F.when(v != "", v).otherwise(first_made(rest))) if rest else value


def value_after_label(line: Column, label: str) -> Column:
    """What follows the label on its line, up to the nearest other label or section word."""
    stops = [w for w in (*P.TITLE_LABELS, *P.OTHER_LABELS, *P.SECTION_WORDS) if w != label]

    def ended(after: Column) -> Column:
        ends = F.filter(F.array(*[F.instr(after, w) for w in stops]), lambda k: k > 0)
        return clean_value(F.when(F.size(ends) > 0, after.substr(F.lit(1), F.array_min(ends) - 1)).otherwise(after))

    return let(line, lambda x: F.when(~x.contains(label), empty()).otherwise(let(x.substr(F.instr(x, label) + len(label), F.length(x)), ended)))


def _following(lines: Column, at: Column, label: str, look_ahead: int) -> Column:
    """Lines after `at`, at most look_ahead, before another label or a section begins."""
    others = "|".join(w for w in P.TITLE_LABELS if w != label)
    after = F.slice(lines, at + 2, F.lit(look_ahead))
    return let(after, lambda x: F.slice(x, F.lit(1), first_line_index(x, f"^(?:{others}|権利部|甲区|乙区)", F.size(x))))


def label_value(lines: Column, label: str, look_ahead: int) -> Column:
    """Value on the label's line, else the plausible lines after it in one."""

    def at_line(s: Column) -> Column:
        same = value_after_label(F.get(s["l"], s["i"]), label)
        more = clean_value(F.array_join(F.filter(_following(s["l"], s["i"], label, look_ahead), is_plausible), " "))
        return F.when(s["i"] < 0, empty()).otherwise(let(same, lambda v: F.when((v != "") & is_plausible(v), v).otherwise(more)))

    return let(F.struct(lines.alias("l"), first_line_index(lines, label).alias("i")), at_line)


def inline_row_value(lines: Column, label: str) -> Column:
    """The first line that gives a value after the label, on the line or in the cell after the label's."""

    def cell_after(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, P.WS + "+", -1), clean_value), lambda x: x != "")
        return let(cells, lambda c: F.when(F.array_contains(c, label), F.coalesce(F.get(c, F.array_position(c, label).cast("int")), empty())).otherwise(""))

    def of(line: Column) -> Column:
        plausible = lambda v: F.when((v != "") & is_plausible(v), v).otherwise("")
        return let(let(value_after_label(line, label), plausible), lambda v: F.when(v != "", v).otherwise(let(cell_after(line), plausible)))

    return first_of(F.transform(F.filter(lines, lambda x: x.contains(label)), of))


def area_by_label(lines: Column, label: str, look_ahead: int, marks: Column | None = None) -> Column:
    """A well-formed area on the label's line, else the first in the lines after it; marks of the lines tell the line sooner."""

    def at_line(s: Column) -> Column:
        same = safe_area(value_after_label(F.get(s["l"], s["i"]), label))
        more = first_of(F.transform(_following(s["l"], s["i"], label, look_ahead), safe_area))
        return F.when(s["i"] < 0, empty()).otherwise(let(same, lambda v: F.when(v != "", v).otherwise(more)))

    at = first_line_index(lines, label) if marks is None else first_marked(marks, label)
    return let(F.struct(lines.alias("l"), at.alias("i")), at_line)


def extract_location(title: Column) -> Column:
    lines = F.filter(title, lambda x: x.rlike("[都道府県].*?[市区町村]"))
    return first_made([safe_location(x) for x in (inline_row_value(title, "所在"), label_value(title, "所在", 6), F.coalesce(F.get(lines, F.lit(0)), empty()))])


def extract_lot_number(title: Column) -> Column:
    """The first named candidate with a number decides; without one, a marked number anywhere in the title."""
    named = [F.regexp_extract(clean_value(x), f"({P.LOT_NUMBER})", 1) for x in (inline_row_value(title, "地番"), label_value(title, "地番", 5))]
    joined = F.array_join(title, " ")
    scan = F.when(joined.rlike(P.LAND_WORDS), F.regexp_extract(joined, f"({P.LOT_NUMBER_MARKED})", 1)).otherwise("")
    return safe_number(first_made([*named, scan]))


def extract_land_area(title: Column, all_lines: Column, marks: Column | None = None) -> Column:
    return first_made([area_by_label(title, "地積", 5), area_by_label(all_lines, "地積", 2, marks)])


def extract_building_area(title: Column, all_lines: Column, marks: Column | None = None) -> Column:
    return first_made([area_by_label(lines, label, n, m) for lines, n, m in ((title, 5, None), (all_lines, 2, marks)) for label in ("床面積", "建物面積")])
