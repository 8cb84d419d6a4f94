"""Lines of a text and the sections of a certificate, as arrays within a row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.predicates import noise_cleaned
from registry_jobs.functions.text import clean_value, let

def no_lines() -> Column:
    return F.array().cast("array<string>")


def none_of(lines: Column) -> Column:
    """No lines, of the type of lines."""
    return F.slice(lines, 1, 0)


def line_array(text: Column) -> Column:
    """Cleaned lines that hold something and aren't noise."""
    cleaned = F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), clean_value)
    return F.filter(F.filter(cleaned, lambda x: x != ""), lambda x: ~noise_cleaned(x))


def lines_of(df: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, line_no, line), line_no from 0."""
    return df.select("doc_id", F.posexplode(line_array(F.col(text))).alias("line_no", "line"))


def first_line_index(lines: Column, pattern: str, missing: Column | int = -1) -> Column:
    none = missing if isinstance(missing, Column) else F.lit(missing)
    if "^" in pattern:
        at = F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True).cast("int")
        return F.when(at > 0, at - 1).otherwise(none)

    # words: one search over the lines joined, which ends at the first match; its line is told by the line ends before it
    def at_text(x: Column) -> Column:
        before = F.regexp_extract(x, f"(?s)^(.*?)(?:{pattern})", 1)
        return F.when(x.rlike(pattern), F.length(before) - F.length(F.replace(before, F.lit("\n"))))

    return F.coalesce(let(F.array_join(lines, "\n"), at_text), none)


def cut(lines: Column, begin: Column, end: Column) -> Column:
    """Lines begin to end - 1, from 0."""
    return F.when(end > begin, F.slice(lines, begin + 1, end - begin)).otherwise(none_of(lines))


def cut_excluded(lines: Column, first: Callable = first_line_index) -> Column:
    """Lines before the first about rights other than ownership."""
    return let(lines, lambda x: cut(x, F.lit(0), first(x, P.EXCLUDED_RIGHTS, F.size(x))))


def split_sections(lines: Column, first: Callable = first_line_index) -> Column:
    """struct(title, rights, kouku, otsuku, collateral) of arrays of lines, or of marks where `first` is first_marked()."""

    def located(x: Column) -> Column:
        return F.struct(
            x.alias("all"),
            F.size(x).alias("n"),
            first(x, P.TITLE_START, 0).alias("title"),
            first(x, "権利部").alias("rights"),
            first(x, "甲区").alias("kouku"),
        )

    def halves(p: Column) -> Column:
        start = F.when(p["rights"] >= 0, p["rights"]).when(p["kouku"] >= 0, p["kouku"]).otherwise(F.least(p["n"], p["title"] + 120))
        return F.struct(
            let(cut(p["all"], p["title"], F.when(start > p["title"], start).otherwise(p["n"])), lambda t: cut(t, F.lit(0), first(t, P.TITLE_STOP, F.size(t)))).alias("title"),
            cut(p["all"], start, p["n"]).alias("rights"),
        )

    def parts(h: Column) -> Column:
        return F.struct(
            h["title"].alias("title"),
            h["rights"].alias("rights"),
            F.size(h["rights"]).alias("n"),
            first(h["rights"], "甲区").alias("k"),
            first(h["rights"], "乙区").alias("o"),
            first(h["rights"], P.COLLATERAL).alias("c"),
        )

    def sections(s: Column) -> Column:
        r, n, k, o, c = s["rights"], s["n"], s["k"], s["o"], s["c"]
        both = (k >= 0) & (o >= 0)
        kouku = (
            F.when(both & (k < o), cut(r, k, o))
            .when(both, cut(r, k, n))
            .when(k >= 0, cut(r, k, F.when(c > k, c).otherwise(n)))
            .otherwise(r)
        )
        otsuku = F.when(both & (k < o), cut(r, o, F.when(c > o, c).otherwise(n))).when(both, cut(r, o, k)).otherwise(none_of(r))
        return F.struct(
            s["title"].alias("title"),
            r.alias("rights"),
            cut_excluded(kouku, first).alias("kouku"),
            otsuku.alias("otsuku"),
            F.when(c >= 0, cut(r, c, n)).otherwise(none_of(r)).alias("collateral"),
        )

    return let(let(let(let(lines, located), halves), parts), sections)


def section_lines(df: DataFrame, sections: str = "sections") -> DataFrame:
    """(doc_id, section, line_no, line): the long form, a row for each line of each section."""
    s = F.col(sections)
    named = F.array(*[F.struct(F.lit(n).alias("section"), s[n].alias("lines")) for n in ("title", "rights", "kouku", "otsuku", "collateral")])
    out = df.select("doc_id", F.explode(named).alias("x"))
    return out.select("doc_id", F.col("x.section").alias("section"), F.posexplode("x.lines").alias("line_no", "line"))
