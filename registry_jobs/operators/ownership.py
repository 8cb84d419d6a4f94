"""Replay of ownership events, history, fallback, and the extracted record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions.marks import first_marked, marked
from registry_jobs.functions.predicates import is_history_noise, is_plausible, safe_owner
from registry_jobs.functions.text import clean_value, js_trim, let, normal_of_text, once, unique_clean
from registry_jobs.operators.events import marked_entries
from registry_jobs.operators.sections import no_lines, split_sections
from registry_jobs.operators.title import empty, extract_building_area, extract_land_area, extract_location, extract_lot_number


def valid_entries(entries: Column) -> Column:
    return F.filter(entries, lambda e: e["ownership_event"] & ~e["invalid"])


def history_clean(text: Column) -> Column:
    def spaced(x: Column) -> Column:
        out = F.regexp_replace(x, f"権利者:{P.WS}*([^|]+?){P.WS}*持分", "権利者: $1 持分")
        return js_trim(F.regexp_replace(out, P.WS + "{2,}", " "))

    return let(clean_value(text), lambda x: F.when(x.contains("権利者:") & x.contains("持分"), spaced(x)).otherwise(x))


def joined(values: Column) -> Column:
    return F.array_join(values, " / ")


def parts_joined(separator: str, *parts: tuple[Column, Column]) -> Column:
    """The texts whose condition holds, joined."""
    return F.array_join(F.filter(F.array(*[F.when(c, t) for c, t in parts]), lambda x: x.isNotNull()), separator)


def entry_summary(e: Column) -> Column:
    has = F.size(e["owners"]) > 0
    return history_clean(
        parts_joined(
            " / ",
            (e["purpose"] != "", e["purpose"]),
            (e["receipt"] != "", F.concat(F.lit("receipt "), e["receipt"])),
            (e["cause"] != "", F.concat(F.lit("cause "), e["cause"])),
            (has, F.concat(F.when(e["shared"], "co-owner candidate").otherwise("owner"), F.lit(" "), joined(e["owners"]))),
            (e["shared"] & ~has, F.lit("co-owner candidate exists")),
            (F.size(e["persons"]) > 0, F.concat(F.lit("person OCR candidate "), joined(e["persons"]))),
        )
    )


def step_kind(e: Column, owners: Column) -> Column:
    """R replaces the owners, S adds sharers, N changes nothing; M is R with sharers of one event."""
    full = e["event_type"] == "full"
    some = F.size(owners) > 0
    alone = full | ((e["event_type"] == "unknown") & some & ~e["shared"])
    return (
        F.when(full & e["shared"] & (F.size(owners) >= 2), "M")
        .when(alone & ~e["shared"], F.when(some, "R").otherwise("N"))
        .when(e["event_type"].isin("partial", "sharePartial") | e["shared"], "S")
        .otherwise("N")
    )


# The sentences of the diagnostics.
def replay(entries: Column, builder: str = P.BUILDER) -> Column:
    """struct(owner, diagnostics): the current owner after the valid events in order, or the refusal to guess."""
    texts = lambda *xs: F.array(*xs).cast("array<string>")
    start = F.struct(no_lines().alias("owners"), F.lit(False).alias("ambiguous"), F.lit(False).alias("seen"), F.lit(False).alias("after"), no_lines().alias("notes"))

    def merge(acc: Column, e: Column) -> Column:
        def known(x: Column) -> Column:
            return F.struct(x.alias("own"), step_kind(e, x).alias("kind"), (acc["seen"] | F.exists(x, lambda o: o.contains(builder))).alias("seen"))

        def moved(x: Column) -> Column:
            shares = x["kind"] == "S"
            replaces = x["kind"].isin("R", "M")
            note = (
                F.when(x["kind"] == "M", texts(F.concat(F.lit("Full event contains multiple owners/share text; kept readable owner list: "), joined(x["own"]))))
                .when(x["kind"] == "R", texts(F.concat(F.lit("Full ownership event replaced owners: "), joined(x["own"]))))
                .when(shares, let(entry_summary(e), lambda s: texts(F.concat(F.lit("Partial/share event retained: "), F.when(s != "", s).otherwise(e["event_type"])))))
                .otherwise(no_lines())
            )
            return F.struct(
                F.when(replaces, x["own"]).when(shares, F.array_distinct(F.concat(acc["owners"], x["own"]))).otherwise(acc["owners"]).alias("owners"),
                (acc["ambiguous"] | shares).alias("ambiguous"),
                x["seen"].alias("seen"),
                (acc["after"] | (shares & (x["seen"] | F.exists(acc["owners"], lambda o: o.contains(builder))))).alias("after"),
                F.concat(acc["notes"], note).alias("notes"),
            )

        return let(known(e["owners"]), moved)  # safe already: owner_candidates() takes no other

    def finish(acc: Column) -> Column:
        others = F.filter(acc["owners"], lambda o: ~o.contains(builder))
        owner = (
            F.when(acc["after"], P.COOWNERS)
            .when(acc["ambiguous"], F.when(F.size(others) >= 2, joined(others)).otherwise(P.COOWNERS))
            .otherwise(joined(acc["owners"]))
        )
        return F.struct(owner.alias("owner"), acc["after"].alias("after"), acc["notes"].alias("notes"))

    def latest(v: Column) -> Column:
        """What the last event that says something says: mostly the last one."""
        some = F.filter(F.transform(v, entry_summary), lambda s: s != "")
        last = let(entry_summary(F.get(v, F.size(v) - 1)), lambda s: F.when(s != "", s).otherwise(F.coalesce(F.try_element_at(some, F.lit(-1)), empty())))
        return F.when(F.size(v) > 0, last).otherwise(empty())

    def told(x: Column) -> Column:
        r, n, last = x["r"], x["n"], x["latest"]
        notes = F.concat(
            texts(F.concat(F.lit("Kouku event count: "), n.cast("string"))),
            r["notes"],
            F.when(r["after"], texts(F.lit("Later partial/share transfer exists; Earnest One was not adopted as sole latest owner."))).otherwise(no_lines()),
            F.when(last != "", texts(F.concat(F.lit("Latest event used for owner judgment: "), last))).otherwise(no_lines()),
            texts(F.concat(F.lit("Assembled ownership state: "), F.when(r["owner"] != "", r["owner"]).otherwise("unconfirmed"))),
        )
        return F.struct(r["owner"].alias("owner"), unique_clean(notes).alias("diagnostics"))

    return let(valid_entries(entries), lambda v: let(F.struct(F.aggregate(v, start, merge, finish).alias("r"), latest(v).alias("latest"), F.size(v).alias("n")), told))


def latest_owners(entries: Column) -> Column:
    return F.coalesce(F.try_element_at(valid_entries(entries), F.lit(-1))["owners"], no_lines())


def history_item(e: Column) -> Column:
    has = F.size(e["owners"]) > 0
    merged = history_clean(
        parts_joined(
            " ",
            (e["purpose"] != "", e["purpose"]),
            (e["receipt"] != "", F.concat(F.lit("受付: "), e["receipt"])),
            (e["cause"] != "", F.concat(F.lit("原因: "), e["cause"])),
            (has, F.concat(F.when(e["shared"], "共有者候補").otherwise("権利者"), F.lit(": "), joined(e["owners"]))),
            (e["shared"] & ~has, F.lit(P.COOWNERS)),
            (e["shared"] & (F.size(e["persons"]) > 0), F.concat(F.lit("人名OCR候補: "), joined(e["persons"]))),
            (e["share"] != "", e["share"]),
        )
    )
    return let(merged, lambda m: F.when(e["plain"] & (e["purpose"] != ""), m).when((m != "") & ~is_history_noise(m) & is_plausible(m), m).otherwise(""))


def owner_history(entries: Column, all_lines: Column, cap: int = 30) -> Column:
    """What each valid event says; without any, lines of the document that speak of events."""
    structured = F.filter(F.transform(valid_entries(entries), history_item), lambda x: x != "")
    loose = F.filter(all_lines, lambda x: x.rlike(P.HISTORY_WORDS) & is_plausible(x) & ~is_history_noise(x))
    return let(structured, lambda s: F.slice(F.when(F.size(s) > 0, F.array_distinct(s)).otherwise(unique_clean(loose)), 1, cap))


def last_two(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 2, F.slice(v, -2, 2)).otherwise(v))


def fallback_owners(all_lines: Column, history: Column) -> Column:
    """The last two safe owners of labelled lines, else of the history."""
    holder = f"^(所有者|権利者その他事項|権利者|共有者){P.WS}*[:：]?"
    named = F.transform(F.filter(all_lines, lambda x: x.rlike("所有者|権利者|共有者")), lambda x: safe_owner(js_trim(F.regexp_replace(x, holder, ""))))
    told = F.flatten(F.transform(history, lambda x: F.split(F.regexp_replace(x, f"^.*権利者:{P.WS}*", ""), "/", -1)))
    from_history = F.filter(F.transform(told, lambda x: safe_owner(clean_value(x))), lambda x: x != "")
    return let(F.filter(named, lambda x: x != ""), lambda v: unique_clean(last_two(F.when(F.size(v) > 0, v).otherwise(from_history))))


def or_none(value: Column, found: Column, none: str) -> Column:
    return F.when(value != "", found).otherwise(none)


# The sentences of the diagnostics, here and in replay(), are those that users' reports are read by.
def field_diagnostics(sections: Column, f: Column) -> Column:
    """Ten lines on what was found. Title and building title are always 'not found': the patterns they stand
    for match no well-formed text."""
    t = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    field = lambda name: or_none(f[name], f[name], "not detected")
    excluded = lambda name: F.when(F.size(sections[name]) > 0, "found and excluded").otherwise("none")
    return F.array(
        F.lit("Title section: not found"),
        t("Title lines inspected: ", F.size(sections["title"]).cast("string")),
        t("Location: ", or_none(f["location"], t("accepted from title section: ", f["location"]), "not detected; rejected owner-address/collateral/noisy candidates")),
        t("Number: ", or_none(f["lot_number"], t("accepted near title land-number label: ", f["lot_number"]), "not detected; map-number/address-number/collateral candidates rejected")),
        t("Land area: ", or_none(f["land_area"], t("accepted near title land-area label: ", f["land_area"]), "not detected; unlabeled small area/debt amount candidates rejected")),
        F.lit("Building title: not found"),
        t("Building area: ", or_none(f["building_area"], t("accepted near floor-area/building-area label: ", f["building_area"]), "not detected or building title not present")),
        t("Otsuku exclusion: ", excluded("otsuku")),
        t("Collateral exclusion: ", excluded("collateral")),
        t("Export values: owner=", field("owner"), " / location=", field("location"), " / number=", field("lot_number"), " / area=", field("land_area"), " / buildingArea=", field("building_area")),
    )


def _found() -> Column:
    all_lines, sections, entries = F.col("lines"), F.col("sections"), F.col("entries")
    fallback = F.when(F.size(valid_entries(entries)) > 0, no_lines()).otherwise(fallback_owners(all_lines, F.col("history")))
    return F.struct(
        extract_location(sections["title"]).alias("location"),
        extract_lot_number(sections["title"]).alias("lot_number"),
        extract_land_area(sections["title"], all_lines, F.col("marks")).alias("land_area"),
        extract_building_area(sections["title"], all_lines, F.col("marks")).alias("building_area"),
        let(F.col("state.owner"), lambda o: F.when(o != "", o).otherwise(joined(F.filter(F.transform(fallback, safe_owner), lambda x: x != "")))).alias("owner"),
        F.col("history").alias("history"),  # plausible and no garbage: owner_history() takes no other
        F.col("state.diagnostics").alias("ownership_diagnostics"),
    )


#: The steps of an extraction in order, each a column of the ones before.
def _line(marks: Column) -> Column:
    return F.transform(marks, lambda m: m["line"])


_LINES = once(
    lambda: {
        "marks": marked(F.col("text")),
        "parts": split_sections(F.col("marks"), first_marked),
        "lines": _line(F.col("marks")),
        "sections": F.struct(*[_line(F.col(f"parts.{n}")).alias(n) for n in ("title", "rights", "kouku", "otsuku", "collateral")]),
        "entries": marked_entries(F.col("parts.kouku")),
    }
)
_RECORD = once(
    lambda: {
        "history": owner_history(F.col("entries"), F.col("lines")),
        "state": replay(F.col("entries")),
        "found": _found(),
        "fields": F.struct("found.*", field_diagnostics(F.col("sections"), F.col("found")).alias("field_diagnostics"), F.col("text").alias("raw")),
    }
)


def with_lines(df: DataFrame) -> DataFrame:
    """df (doc_id, text, ...) with the array columns that fields and events are read from."""
    for name, column in _LINES().items():
        df = df.withColumn(name, column)
    return df


def extract_normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """df, text being normalised, with `fields`: the record read from it. One narrow projection after another.

    Columns of df with the names of the steps are set aside in one struct meanwhile.
    """
    steps = {**_LINES(), **_RECORD()}
    clash = text != "text" or set(df.columns) & set(steps)
    out = df.select(F.struct("*").alias("row"), F.col(text).alias("text")) if clash else df
    for name, column in steps.items():
        out = out.withColumn(name, column)
    return out.select(*[(F.col("row")[c].alias(c) if clash else c) for c in df.columns if c != "fields"], "fields")


def extract_fields(df: DataFrame, text: str = "text") -> DataFrame:
    """df (doc_id, text, ...) with `fields`: the record of each text. Null text gives the empty record."""
    kept = df.select(F.struct("*").alias("row"), F.col(text).alias("text")).select("row", normal_of_text().alias("text"))
    return extract_normalized(kept).select(*[F.col("row")[c].alias(c) for c in df.columns if c != "fields"], "fields")


def replay_rows(entries: DataFrame, builder: str = P.BUILDER) -> DataFrame:
    """(doc_id, owner) from entry rows (doc_id, entry_no, event_type, shared, owners, invalid, ownership_event):
    the relational form of replay(), by windows over doc_id."""
    e = entries.where("ownership_event and not invalid").withColumn("own", F.filter(F.transform("owners", safe_owner), lambda x: x != ""))
    row = F.struct("event_type", "shared")
    e = e.withColumn("kind", step_kind(row, F.col("own")))
    doc = Window.partitionBy("doc_id")
    e = (
        e.withColumn("last_r", F.max(F.when(F.col("kind").isin("R", "M"), F.col("entry_no"))).over(doc))
        .withColumn("builder_at", F.min(F.when(F.exists("own", lambda o: o.contains(builder)), F.col("entry_no"))).over(doc))
        .withColumn("ambiguous", F.max(F.when(F.col("kind") == "S", 1).otherwise(0)).over(doc))
        .withColumn("after", F.max(F.when((F.col("kind") == "S") & (F.col("entry_no") >= F.col("builder_at")), 1).otherwise(0)).over(doc))
        .withColumn("stays", (F.col("entry_no") == F.col("last_r")) | ((F.col("kind") == "S") & (F.col("entry_no") > F.coalesce("last_r", F.lit(-1)))))
    )
    names = F.transform(F.array_sort(F.collect_list(F.when(F.col("stays"), F.struct("entry_no", "own")))), lambda x: x["own"])
    out = e.groupBy("doc_id").agg(F.array_distinct(F.flatten(names)).alias("owners"), F.max("ambiguous").alias("ambiguous"), F.max("after").alias("after"))
    others = F.filter("owners", lambda o: ~o.contains(builder))
    owner = F.when((F.col("after") == 1) | ((F.col("ambiguous") == 1) & (F.size(others) < 2)), P.COOWNERS).when(F.col("ambiguous") == 1, joined(others)).otherwise(joined(F.col("owners")))
    return out.select("doc_id", owner.alias("owner"))
