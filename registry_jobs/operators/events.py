"""Ownership events of the ownership register: segmentation into entries, and their attributes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.marks import CAUSE_LABEL, DOUBTFUL, ENTRY_START, PURPOSE, RECEIPT_CHARS, SHARE, has
from registry_jobs.functions.predicates import is_excluded_right, is_header, is_plausible, looks_like_corp, looks_like_person, safe_owner
from registry_jobs.functions.text import clean_value, js_trim, let, unique_clean
from registry_jobs.operators.sections import no_lines, none_of
from registry_jobs.operators.title import empty

HOLDER = f"^(所有者|権利者その他事項|権利者|共有者|氏名){P.WS}*[:：]?"


def is_entry_start(line: Column) -> Column:
    starts = line.rlike(f"^順位番号{P.WS}*[0-9]+|^第?[0-9]+{P.WS}*(?:号|番)|所有権移転|所有権一部移転|持分一部移転")
    return (starts | (line.rlike(f"^[0-9]+{P.WS}+") & line.rlike("原因|登記"))) & ~is_header(line)


def kouku_body(kouku: Column) -> Column:
    return F.filter(kouku, lambda x: ~x.rlike(f"甲区|権利部|{P.HEADER}"))


def segment_entries(body: Column, starts: Callable = is_entry_start) -> Column:
    """Blocks of lines: a start line opens one, lines before the first start are the first."""

    def blocks(x: Column) -> Column:
        n = F.size(x)
        at = F.filter(F.transform(x, lambda line, i: F.when((i == 0) | starts(line), i)), lambda i: i.isNotNull())
        return let(at, lambda s: F.transform(s, lambda b, k: F.slice(x, b + 1, F.coalesce(F.get(s, k + 1), n) - b)))

    return let(body, blocks)


def is_receipt_only(block: Column) -> Column:
    """Blanks anywhere between the letters don't count."""
    return F.array_join(block, " ").rlike(f"^{P.WS}*(?:第{P.WS}*)?[0-9][0-9{P.WS_CHARS}]*号{P.WS}*\\z")


def merge_receipt_blocks(blocks: Column, only: Callable = is_receipt_only) -> Column:
    """A block that is only a receipt goes to the next one, lines first; in a run of them every other goes."""

    def merged(b: Column) -> Column:
        n = F.size(b)
        none = F.flatten(none_of(b))
        start = F.struct(none_of(b).alias("out"), none.alias("held"), F.lit(False).alias("holds"))

        def step(acc: Column, x: Column) -> Column:
            return let(
                x["flag"] & ~acc["holds"] & x["more"],
                lambda goes: F.struct(
                    F.when(goes, acc["out"]).otherwise(F.concat(acc["out"], F.array(F.concat(acc["held"], x["lines"])))).alias("out"),
                    F.when(goes, x["lines"]).otherwise(none_of(x["lines"])).alias("held"),
                    goes.alias("holds"),
                ),
            )

        told = F.transform(b, lambda x, k: F.struct(x.alias("lines"), only(x).alias("flag"), (k < n - 1).alias("more")))
        return F.aggregate(told, start, step, lambda acc: acc["out"])

    return let(blocks, lambda b: F.when(F.exists(b, only), merged(b)).otherwise(b))


def first_line(lines: Column, pattern: str) -> Column:
    return F.coalesce(F.get(F.filter(lines, lambda x: x.rlike(pattern)), F.lit(0)), empty())


def entry_cause(lines: Column) -> Column:
    direct = F.regexp_replace(first_line(lines, "^原因"), f"^原因{P.WS}*[:：]?", "")
    return let(direct, lambda d: clean_value(F.when(d != "", d).otherwise(first_line(lines, P.EVENT_WORDS))))


def entry_receipt(lines: Column) -> Column:
    return clean_value(F.regexp_replace(F.regexp_extract(F.array_join(lines, " "), f"(第{P.WS}*[0-9]{{1,8}}{P.WS}*号)", 1), P.WS, ""))


def entry_purpose(lines: Column) -> Column:
    line = clean_value(F.regexp_replace(first_line(lines, "所有権|持分一部移転"), f"^登記の目的{P.WS}*[:：]?", ""))
    return F.regexp_extract(line, "(所有権保存|所有権一部移転|所有権移転|持分一部移転|所有権)", 1)


def owner_candidates(lines: Column) -> Column:
    """Safe owners named after a holder's label, in order, each once."""

    def of(line: Column) -> Column:
        value = js_trim(F.regexp_replace(line, HOLDER, ""))
        named = let(value, lambda v: F.when(v != "", F.concat(F.array(v), F.transform(F.split(v, "[／/]", -1), clean_value))).otherwise(no_lines()))
        inline = F.regexp_extract_all(line, F.lit(f"(?:所有者|権利者|共有者){P.WS}*[:：]?{P.WS}*([^{P.WS_CHARS}]+)"), F.lit(1))
        return F.concat(named, inline)

    fit = F.filter(lines, lambda x: x.rlike("所有者|権利者|共有者|氏名") & is_plausible(x) & ~is_header(x) & ~is_excluded_right(x) & ~x.contains("OCR候補"))
    safe = F.filter(F.transform(unique_clean(F.flatten(F.transform(fit, of))), safe_owner), lambda x: x != "")
    return unique_clean(F.filter(safe, lambda x: ~x.rlike("^(持分|住所|受付|順位|原因|記載)") & (looks_like_corp(x) | looks_like_person(x))))


def event_type(purpose: Column, lines: Column) -> Column:
    return let(
        F.concat_ws(" ", purpose, F.array_join(lines, " ")),
        lambda x: F.when(x.contains("持分一部移転"), "sharePartial").when(x.contains("所有権一部移転"), "partial").when(x.contains("所有権"), "full").otherwise("unknown"),
    )


def is_invalid(cause: Column, lines: Column) -> Column:
    return F.concat_ws(" ", cause, F.array_join(lines, " ")).rlike(P.INVALID_WORDS)


def is_ownership_event(cause: Column, lines: Column) -> Column:
    return F.concat_ws(" ", cause, F.array_join(lines, " ")).rlike(P.OWNERSHIP_WORDS)


def has_shared_marker(kind: Column, lines: Column) -> Column:
    return kind.isin("partial", "sharePartial") | F.exists(lines, lambda x: x.contains("共有者") | x.contains("持分"))


def share_fraction(lines: Column) -> Column:
    found = F.transform(lines, lambda x: F.regexp_extract(x, f"持分{P.WS}*[0-9]+分の[0-9]+", 0))
    return F.regexp_replace(F.coalesce(F.get(F.filter(found, lambda x: x != ""), F.lit(0)), empty()), P.WS, "")


def share_candidates(lines: Column) -> Column:
    """Always empty on well-formed text, as the pattern it stands for matches none."""
    return no_lines()


def person_candidates(owners: Column) -> Column:
    return F.slice(unique_clean(F.filter(owners, lambda x: looks_like_person(x) & ~looks_like_corp(x))), 1, 12)


def entry_record(lines: Column) -> Column:
    def base(x: Column) -> Column:
        return F.struct(x.alias("lines"), entry_purpose(x).alias("purpose"), entry_receipt(x).alias("receipt"), entry_cause(x).alias("cause"), owner_candidates(x).alias("owners"))

    def full(e: Column) -> Column:
        kind = event_type(e["purpose"], e["lines"])
        return F.struct(
            e["lines"].alias("lines"), e["purpose"].alias("purpose"), e["receipt"].alias("receipt"), e["cause"].alias("cause"), e["owners"].alias("owners"), kind.alias("event_type"),
            person_candidates(e["owners"]).alias("persons"), share_fraction(e["lines"]).alias("share"), has_shared_marker(kind, e["lines"]).alias("shared"),
            is_invalid(e["cause"], e["lines"]).alias("invalid"), is_ownership_event(e["cause"], e["lines"]).alias("ownership_event"), F.lit(False).alias("plain"),
        )

    return let(let(lines, base), full)


def parse_entries(kouku: Column) -> Column:
    """array<struct> of the entries of the ownership register's lines."""
    return F.transform(merge_receipt_blocks(segment_entries(kouku_body(kouku))), entry_record)


def marked_record(marks: Column) -> Column:
    """entry_record() of the marks of an entry's lines. What its words say is told by the bits of all its lines, as no word is
    made by taking a label away or by joining; `plain` is whether none of them is doubtful."""

    def base(x: Column) -> Column:
        return F.struct(x.alias("marks"), F.transform(x, lambda m: m["line"]).alias("lines"), F.aggregate(x, F.lit(0).cast("long"), lambda a, m: a.bitwiseOR(m["bits"])).alias("bits"))

    def full(e: Column) -> Column:
        x, lines, b = e["marks"], e["lines"], e["bits"]
        one = lambda pattern: F.get(F.filter(x, lambda m: has(m["bits"], pattern)), F.lit(0))
        when = lambda pattern, value: F.when(has(b, pattern), value)
        partial = F.when(has(b, "持分一部移転"), "sharePartial").when(has(b, "所有権一部移転"), "partial")
        return F.struct(
            lines.alias("lines"), F.coalesce(when(PURPOSE, one(PURPOSE)["purpose"]), empty()).alias("purpose"), when("第", entry_receipt(lines)).otherwise(empty()).alias("receipt"),
            F.coalesce(when(CAUSE_LABEL, one(CAUSE_LABEL)["cause"]), when(P.EVENT_WORDS, one(P.EVENT_WORDS)["line"]), empty()).alias("cause"),
            F.array_distinct(F.flatten(F.transform(x, lambda m: m["owners"]))).alias("owners"), partial.when(has(b, "所有権"), "full").otherwise("unknown").alias("event_type"),
            F.slice(F.array_distinct(F.flatten(F.transform(x, lambda m: m["persons"]))), 1, 12).alias("persons"), when(SHARE, share_fraction(lines)).otherwise(empty()).alias("share"),
            has(b, "持分一部移転", "所有権一部移転", "共有者|持分").alias("shared"), has(b, P.INVALID_WORDS).alias("invalid"), has(b, P.OWNERSHIP_WORDS).alias("ownership_event"),
            (~has(b, DOUBTFUL)).alias("plain"),
        )

    return let(let(marks, base), full)


def marked_entries(kouku: Column) -> Column:
    """parse_entries() of the marks of the ownership register's lines."""
    body = F.filter(kouku, lambda m: ~has(m["bits"], "甲区", "権利部", P.HEADER))
    only = lambda b: F.when(F.forall(b, lambda m: has(m["bits"], RECEIPT_CHARS)), is_receipt_only(F.transform(b, lambda m: m["line"]))).otherwise(False)
    return F.transform(merge_receipt_blocks(segment_entries(body, lambda m: has(m["bits"], ENTRY_START)), only), marked_record)


def entry_rows(df: DataFrame, entries: str = "entries") -> DataFrame:
    """(doc_id, entry_no, ...): one row per entry."""
    return df.select("doc_id", F.posexplode(entries).alias("entry_no", "e")).select("doc_id", "entry_no", "e.*")
