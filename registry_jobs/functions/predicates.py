"""Predicates and safe filters on lines and values. Patterns that stop at a line end do so as in the texts'
source language: lines here hold none."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.text import clean_value, compact, js_trim, let

def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def chars(text: Column, one: str) -> Column:
    """How many characters are of the class `one`: what is missing when its runs are taken out."""
    return F.length(text) - F.length(F.regexp_replace(text, one + "+", ""))


def words_of_4(text: Column, least: int) -> Column:
    """Whether there are at least so many Latin words of four letters and more; most lines have no four letters."""
    return text.rlike("[A-Za-z]{4}") & (count(text, P.WORD4_JAVA) >= least)


def share(text: Column, pattern: str) -> Column:
    """Share of the characters of a text that isn't empty."""
    return chars(text, pattern) / F.greatest(F.length(text), F.lit(1))


def has_japanese(text: Column) -> Column:
    return text.rlike(P.JAPANESE)


def noise_cleaned(x: Column) -> Column:
    return (x == "") | ~x.rlike(f"[{P.KANJI_KANA_CHARS}a-zA-Z0-9]") | ((F.length(x) > 6) & x.rlike(r"(.)\1{6,}")) | x.rlike(r"^[a-zA-Z0-9]{1,2}\z")


def is_noise_line(line: Column) -> Column:
    return let(clean_value(line), noise_cleaned)


def looks_like_garbage(text: Column) -> Column:
    """Never a text with Japanese and no four Latin letters in a row, which most are."""

    def of(x: Column) -> Column:
        c, t = x["c"], x["t"]
        japanese = has_japanese(c)
        alnum = share(c, P.ALNUM)
        foreign = ((F.length(c) >= 6) & (alnum >= 0.55)) | (share(c, P.SYMBOL) >= 0.35) | t.rlike(P.CAPITALS_OR_WORD5_JAVA)
        return F.when(c == "", True).otherwise((~japanese & foreign) | (words_of_4(t, 2) & (alnum >= 0.35)))

    return let(text, lambda t: F.when(has_japanese(t) & ~t.rlike("[A-Za-z]{4}"), False).otherwise(let(F.struct(compact(t).alias("c"), t.alias("t")), of)))


def plausible_cleaned(x: Column) -> Column:
    run = F.when(F.length(x) > 6, x.rlike(r"(.)\1{6,}")).otherwise(False)
    return F.when(x.rlike(P.PLAIN_JAVA), ~run).otherwise(~noise_cleaned(x) & ~x.contains("\ufffd") & ~looks_like_garbage(x))


def is_plausible(text: Column) -> Column:
    return let(clean_value(text), plausible_cleaned)


def has_contamination(text: Column) -> Column:
    return text.rlike(P.CONTAMINATION)


def _noise(text: Column, pattern: str, limit: float) -> Column:
    """Whether nothing but white space is there, or too much of the pattern; without any of it, only the former."""
    return F.when(text.rlike(pattern), let(compact(text), lambda c: share(c, pattern) > limit)).otherwise(~text.rlike(f"[^{P.WS_CHARS}]"))


def ascii_noise(text: Column, limit: float = 0.25) -> Column:
    return _noise(text, r"[A-Za-z*]", limit)


def symbol_noise(text: Column, limit: float = 0.12) -> Column:
    return _noise(text, r"[%@|｜*_~#=+<>\\]", limit)


def has_noise_token(text: Column) -> Column:
    return text.rlike(P.NOISE_TOKENS)


def is_header(line: Column) -> Column:
    return line.rlike(P.HEADER)


def is_excluded_right(line: Column) -> Column:
    return line.rlike(P.EXCLUDED_RIGHTS)


def looks_like_corp(text: Column) -> Column:
    return text.rlike(P.CORPORATION)


def person_cleaned(v: Column) -> Column:
    return (v != "") & v.rlike(P.PERSON) & ~v.rlike("[0-9]{3,}") & ~v.rlike(P.NOT_PERSON)


def looks_like_person(text: Column) -> Column:
    return let(clean_value(text), person_cleaned)


def looks_like_address(text: Column) -> Column:
    return text.rlike(P.ADDRESS)


def safe_location(text: Column) -> Column:
    def of(x: Column) -> Column:
        good = (
            (x != "") & plausible_cleaned(x) & has_japanese(x) & ~ascii_noise(x, 0.18) & ~symbol_noise(x, 0.08)
            & ~has_noise_token(x) & ~has_contamination(x) & ~x.rlike(P.LOCATION_REJECT)
        )
        return F.when(good, x).otherwise("")

    return let(clean_value(text), of)


def safe_number(text: Column) -> Column:
    return let(clean_value(text), lambda x: F.when((x != "") & x.rlike(f"^(?:{P.LOT_NUMBER})\\z") & ~looks_like_garbage(x), x).otherwise(""))


def normalize_area(text: Column) -> Column:
    def of(x: Column) -> Column:
        found = F.regexp_extract(x, f"([0-9]+(?:\\.[0-9]+)?){P.WS}*㎡", 1)
        return F.when(found != "", F.concat(found, F.lit("㎡"))).otherwise(x)

    return let(F.regexp_replace(clean_value(text), "平方メートル", "㎡"), of)


def safe_area(text: Column) -> Column:
    return let(normalize_area(text), lambda x: F.when(x.rlike(r"^[0-9]{1,7}(?:\.[0-9]{1,2})?㎡\z"), x).otherwise(""))


def strip_annotation(text: Column) -> Column:
    """An owner's name without share, address or receipt after it."""
    return let(clean_value(text), lambda x: F.when(x.rlike("持分|住所|受付"), js_trim(F.regexp_replace(x, "(?:持分|住所|受付).*", ""))).otherwise(x))


def safe_owner(text: Column) -> Column:
    def of(x: Column) -> Column:
        rejected = (
            (x == "") | ~plausible_cleaned(x) | x.rlike(P.OWNER_REJECT) | F.when(x.rlike(r"[A-Za-z%@|｜*_~#=+<>\\]"), ascii_noise(x, 0.12) | symbol_noise(x, 0.02)).otherwise(False)
            | (x.contains("会社") & ~looks_like_corp(x)) | (F.length(x) > 40)
        )
        return F.when((looks_like_corp(x) | person_cleaned(x)) & ~rejected, x).otherwise("")

    return let(strip_annotation(text), of)


def is_history_noise(text: Column) -> Column:
    return let(
        clean_value(text), lambda x: (x == "") | x.rlike(P.HISTORY_REJECT) | looks_like_garbage(x)
    )


def count_history_noise(text: Column) -> Column:
    lines = F.split(F.coalesce(text, F.lit("")), "\n+", -1)
    return F.size(F.filter(lines, lambda x: js_trim(x).rlike(P.LIKELY_HISTORY_NOISE))).cast("long")
