"""The text fields and the history of a normalised text, by one vectorised helper over the marks of its lines.

An election reads no more of a reading than these, and each document has several readings that mostly say the same: a title, an entry and a
text are each read once while they are near. The built-in functions of `sections`, `title`, `events` and `ownership` stay the form with
diagnostics, and for single columns; a test holds both equal.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import marks as M
from registry_jobs.functions import patterns as P
from registry_jobs.functions import quality as Q
from registry_jobs.functions import text as T

FIELDS = ("location", "lot_number", "land_area", "building_area", "owner")
RECORD = f"struct<{','.join(f'{n}:string' for n in FIELDS)},history:array<string>>"
HISTORY_CAP = 30
_B = M.BITS
_EVENT, _INVALID, _DOUBTFUL, _PURPOSE, _CAUSE, _SHARE, _ENTRY, _RECEIPT = (_B[p] for p in (P.OWNERSHIP_WORDS, P.INVALID_WORDS, M.DOUBTFUL, M.PURPOSE, M.CAUSE_LABEL, M.SHARE, M.ENTRY_START, M.RECEIPT_CHARS))
_SHARED = _B["持分一部移転"] | _B["所有権一部移転"] | _B["共有者|持分"]
_HEADS = _B["甲区"] | _B["権利部"] | _B[P.HEADER]
_HEADS_ENTRY_RECEIPT = _HEADS | _ENTRY | _RECEIPT
_KEPT_TEXT = 20_000  # characters up to which a text's record, its title and its entries are kept


@lru_cache(maxsize=1)
def _looks() -> dict[str, re.Pattern]:
    ws = P.WS
    more = {
        "receipt_only": f"^{ws}*(?:第{ws}*)?[0-9][0-9{P.WS_CHARS}]*号{ws}*\\z", "receipt": f"(第{ws}*[0-9]{{1,8}}{ws}*号)", "share": f"持分{ws}*[0-9]+分の[0-9]+", "entitled": f"権利者:{ws}*([^|]+?){ws}*持分",
        "cells": ws + "+", "place": "[都道府県].*?[市区町村]", "lot": f"({P.LOT_NUMBER})", "lot_marked": f"({P.LOT_NUMBER_MARKED})", "lot_whole": f"^(?:{P.LOT_NUMBER})\\z",
        "area": f"([0-9]+(?:\\.[0-9]+)?){ws}*㎡", "area_whole": r"^[0-9]{1,7}(?:\.[0-9]{1,2})?㎡\z", "holder": f"^(所有者|権利者その他事項|権利者|共有者){ws}*[:：]?", "told": f"^.*権利者:{ws}*",
        "holders": "所有者|権利者|共有者", **{f"after {n}": "^(?:" + "|".join(w for w in P.TITLE_LABELS if w != n) + "|権利部|甲区|乙区)" for n in P.TITLE_LABELS},
    }
    return M._looks() | {k: M._java(p) for k, p in more.items()} | {p: M._java(p) for p in (P.LOCATION_REJECT, P.NOISE_TOKENS, P.CONTAMINATION, P.HISTORY_REJECT, P.HISTORY_WORDS, P.LAND_WORDS)}


def _first(bits: list[int], bit: int, missing: int = -1) -> int:
    for k, b in enumerate(bits):
        if b & bit:
            return k
    return missing


def _unique(values: list[str]) -> list[str]:
    return list(dict.fromkeys(y for x in values if (y := M._clean(x))))


def _plausible(text: str) -> bool:
    return M._plausible(M._clean(text))


def _history_noise(text: str) -> bool:
    x = M._clean(text)
    return x == "" or bool(_looks()[P.HISTORY_REJECT].search(x)) or M._garbage(x)


# Title
def _safe_location(text: str) -> str:
    r, x = _looks(), M._clean(text)
    bad = x == "" or not r[P.JAPANESE].search(x) or r[P.NOISE_TOKENS].search(x) or r[P.CONTAMINATION].search(x) or r[P.LOCATION_REJECT].search(x)
    return "" if bad or not M._plausible(x) or M._noisy(x, "ascii", 0.18) or M._noisy(x, "symbol", 0.08) else x


def _safe_number(text: str) -> str:
    x = M._clean(text)
    return x if x and _looks()["lot_whole"].search(x) and not M._garbage(x) else ""


def _safe_area(text: str) -> str:
    r = _looks()
    x = M._clean(text).replace("平方メートル", "㎡")
    found = r["area"].search(x)
    x = found[1] + "㎡" if found else x
    return x if r["area_whole"].search(x) else ""


_STOPS = {n: [w for w in (*P.TITLE_LABELS, *P.OTHER_LABELS, *P.SECTION_WORDS) if w != n] for n in P.TITLE_LABELS}


def _after(line: str, label: str) -> str:
    at = line.find(label)
    if at < 0:
        return ""
    after = line[at + len(label) :]
    ends = [k for w in _STOPS[label] if (k := after.find(w)) >= 0]
    return M._clean(after[: min(ends)] if ends else after)


def _index(lines: list[str], label: str) -> int:
    return next((k for k, x in enumerate(lines) if label in x), -1)


def _following(lines: list[str], at: int, label: str, ahead: int) -> list[str]:
    stop, out = _looks()[f"after {label}"], []
    for x in lines[at + 1 : at + 1 + ahead]:
        if stop.search(x):
            break
        out.append(x)
    return out


def _label_value(lines: list[str], label: str, ahead: int) -> str:
    at = _index(lines, label)
    if at < 0:
        return ""
    same = _after(lines[at], label)
    return same if same and _plausible(same) else M._clean(" ".join(x for x in _following(lines, at, label, ahead) if _plausible(x)))


def _row_value(lines: list[str], label: str) -> str:
    for line in lines:
        if label in line:
            value = _after(line, label)
            if not (value and _plausible(value)):
                cells = [y for x in _looks()["cells"].split(line) if (y := M._clean(x))]
                value = cells[k] if label in cells and (k := cells.index(label) + 1) < len(cells) else ""
            if value and _plausible(value):
                return value
    return ""


def _area(lines: list[str], at: int, label: str, ahead: int) -> str:
    if at < 0:
        return ""
    return _safe_area(_after(lines[at], label)) or next((y for x in _following(lines, at, label, ahead) if (y := _safe_area(x))), "")


def _title(title: tuple[str, ...]) -> tuple[str, str, str, str]:
    """(location, lot_number, land_area, building_area) of the title's lines."""
    r, lines = _looks(), list(title)
    location = _safe_location(_row_value(lines, "所在")) or _safe_location(_label_value(lines, "所在", 6)) or _safe_location(next((x for x in lines if r["place"].search(x)), ""))
    number = ""
    for made in (lambda: _row_value(lines, "地番"), lambda: _label_value(lines, "地番", 5)):
        found = None if number else r["lot"].search(M._clean(made()))
        number = found[1] if found else number
    if not number:
        joined = " ".join(lines)
        found = r["lot_marked"].search(joined) if r[P.LAND_WORDS].search(joined) else None
        number = found[1] if found else ""
    area = lambda label: _area(lines, _index(lines, label), label, 5)
    return location, _safe_number(number), area("地積"), area("床面積") or area("建物面積")


# Entries
def _blocks(kouku: list[tuple], bits: list[int]) -> list[list[tuple]]:
    """segment_entries() and merge_receipt_blocks() of the marks of the ownership register, given with their bits."""
    blocks: list[list[tuple]] = []
    receipts = False
    for m, b in zip(kouku, bits, strict=True):
        if b & _HEADS_ENTRY_RECEIPT:
            if b & _HEADS:
                continue
            receipts = receipts or b & _RECEIPT
            if b & _ENTRY or not blocks:
                last = [m]
                blocks.append(last)
                continue
        elif not blocks:
            last = [m]
            blocks.append(last)
            continue
        last.append(m)
    if not receipts:
        return blocks
    only = [all(m[1] & _RECEIPT for m in b) and bool(_looks()["receipt_only"].search(" ".join([m[0] for m in b]))) for b in blocks]
    if True not in only:
        return blocks
    out, held, holds = [], [], False
    for k, b in enumerate(blocks):
        if only[k] and not holds and k < len(blocks) - 1:
            held, holds = b, True
        else:
            out.append(held + b)
            held, holds = [], False
    return out


def _entry(marks: list[tuple]) -> tuple[str, bool, list[str], str] | None:
    """(event type, shared, owners, what the history says) of an entry; None of one that is no valid event."""
    bits = 0
    for m in marks:
        bits |= m[1]
    if not bits & _EVENT or bits & _INVALID:
        return None
    r, lines = _looks(), [m[0] for m in marks]
    one = lambda bit: next(m for m in marks if m[1] & bit)
    purpose = one(_PURPOSE)[2] if bits & _PURPOSE else ""
    found = r["receipt"].search(" ".join(lines)) if bits & _B["第"] else None
    receipt = M._clean(r["blank"].sub("", found[1])) if found else ""
    cause = one(_CAUSE)[3] if bits & _CAUSE else None
    if cause is None:
        cause = one(_B[P.EVENT_WORDS])[0] if bits & _B[P.EVENT_WORDS] else ""
    owners = list(dict.fromkeys(x for m in marks for x in m[4]))
    persons = list(dict.fromkeys(x for m in marks for x in m[5]))[:12]
    kind = "sharePartial" if bits & _B["持分一部移転"] else "partial" if bits & _B["所有権一部移転"] else "full" if bits & _B["所有権"] else "unknown"
    shared = bool(bits & _SHARED)
    share = next((r["blank"].sub("", s[0]) for x in lines if (s := r["share"].search(x))), "") if bits & _SHARE else ""
    parts = [
        purpose, receipt and f"受付: {receipt}", cause and f"原因: {cause}", owners and f"{'共有者候補' if shared else '権利者'}: {' / '.join(owners)}", shared and not owners and P.COOWNERS,
        shared and persons and f"人名OCR候補: {' / '.join(persons)}", share,
    ]
    item = M._clean(" ".join(x for x in parts if x))
    if "権利者:" in item and "持分" in item:
        item = r["blanks"].sub(" ", r["entitled"].sub(r"権利者: \1 持分", item)).strip(P.BLANKS)
    if not (purpose and not bits & _DOUBTFUL) and (item == "" or _history_noise(item) or not _plausible(item)):
        item = ""
    return kind, shared, owners, item


def _owner(events: list[tuple], builder: str = P.BUILDER) -> str:
    """replay(): the current owner after the events in order, or the refusal to guess."""
    owners: list[str] = []
    ambiguous = seen = after = False
    for kind, shared, own, _ in events:
        seen = seen or any(builder in o for o in own)
        if (kind == "full" and shared and len(own) >= 2) or (not shared and own and kind in ("full", "unknown")):
            owners = own
        elif kind != "full" and (shared or kind != "unknown") or shared:
            ambiguous = True
            after = after or seen or any(builder in o for o in owners)
            owners = list(dict.fromkeys([*owners, *own]))
    others = [o for o in owners if builder not in o]
    if after or (ambiguous and len(others) < 2):
        return P.COOWNERS
    return " / ".join(others if ambiguous else owners)


def _last_resort(lines: list[str], history: list[str]) -> str:
    """The safe ones of fallback_owners(), joined."""
    r = _looks()
    found = [y for x in lines if r["holders"].search(x) and (y := M._safe_owner(r["holder"].sub("", x).strip(P.BLANKS)))]
    if not found:
        found = [y for h in history for x in r["told"].sub("", h).split("/") if (y := M._safe_owner(M._clean(x)))]
    return " / ".join(y for x in _unique(found[-2:]) if (y := M._safe_owner(x)))


class _Near:
    """What was made of the last few thousand keys: readings of one document come one after another."""

    def __init__(self, make: Callable, limit: int = 1 << 13) -> None:
        self.make, self.limit, self.held = make, limit, {}

    def __call__(self, key, *given):
        found = self.held.get(key, self)
        if found is self:
            if len(self.held) >= self.limit:
                self.held.clear()
            found = self.held[key] = self.make(*(given or (key,)))
        return found


_near_title, _near_entry = _Near(_title), _Near(_entry)


def _record(text: str) -> tuple:
    lines = text.split("\n")
    if max(map(len, lines)) <= M._KEPT_LINE:
        marks = [m for m in map(M._kept_mark, lines) if m is not None]
    else:
        marks = [m for x in lines if (m := M._kept_mark(x) if len(x) <= M._KEPT_LINE else M._mark(x)) is not None]
    bits = [m[1] for m in marks]
    n, title, rights, kouku = len(marks), _first(bits, _B[P.TITLE_START], 0), _first(bits, _B["権利部"]), _first(bits, _B["甲区"])
    start = rights if rights >= 0 else kouku if kouku >= 0 else min(n, title + 120)
    end = start if start > title else n
    head = marks[title : title + _first(bits[title:end], _B[P.TITLE_STOP], end - title)]
    k, o = _first(bits[start:], _B["甲区"]), _first(bits[start:], _B["乙区"])
    first, last = start, n  # of the ownership register
    if k >= 0:
        first = start + k
        if o > k:
            last = start + o
        elif o < 0:
            c = _first(bits[start:], _B[P.COLLATERAL])
            last = start + c if c > k else n
    last = first + _first(bits[first:last], _B[P.EXCLUDED_RIGHTS], last - first)
    near = len(text) <= _KEPT_TEXT
    events = []
    for block in _blocks(marks[first:last], bits[first:last]):
        event = _near_entry(tuple([m[0] for m in block]), block) if near else _entry(block)
        if event is not None:
            events.append(event)
    history = list(dict.fromkeys([e[3] for e in events if e[3]]))
    owner = _owner(events)
    if not history or not (owner or events):
        lines = [m[0] for m in marks]
        if not history:
            words = _looks()[P.HISTORY_WORDS]
            history = _unique([x for x in lines if words.search(x) and _plausible(x) and not _history_noise(x)])
        if not (owner or events):
            owner = _last_resort(lines, history[:HISTORY_CAP])
    title_lines = tuple([m[0] for m in head])
    location, number, land, building = _near_title(title_lines) if near else _title(title_lines)
    for label in () if land else ("地積",):
        land = _late_area(marks, bits, label)
    for label in () if building else ("床面積", "建物面積"):
        building = building or _late_area(marks, bits, label)
    return location, number, land, building, owner, history[:HISTORY_CAP]


def _late_area(marks: list[tuple], bits: list[int], label: str) -> str:
    """area_by_label() over all lines of the text, two lines ahead."""
    at = _first(bits, _B[label])
    return _area([m[0] for m in marks[at : at + 3]], 0, label, 2) if at >= 0 else ""


_near_record = _Near(_record, 64)


def _records(texts: list[str | None]) -> pa.StructArray:
    found = [_near_record(t) if len(t) <= _KEPT_TEXT else _record(t) for t in (t or "" for t in texts)]
    *values, history = zip(*found, strict=True) if found else ((),) * (len(FIELDS) + 1)
    arrays = [*[pa.array(v, pa.string()) for v in values], M._lists(history, pa.string())]
    return pa.StructArray.from_arrays(arrays, [*FIELDS, "history"])


def _record_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _records(texts.to_pylist())


def record(text: Column) -> Column:
    """struct(location, lot_number, land_area, building_area, owner, history) of a normalised text; of null the empty record."""
    return F.arrow_udf(_record_batches, RECORD)(text)


def _labelled(text: str | None) -> str:
    """normalize_text(), or of null that of an empty text."""
    return "\n".join([u[1] for u in T._units(text)])


def _normal_record_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield _records([_labelled(t) for t in texts.to_pylist()])


def normal_record(text: Column) -> Column:
    """record() of normalize_text() of a text, null as an empty one."""
    return F.arrow_udf(_normal_record_batches, RECORD)(text)


_MEASURES = [x.split() for x in Q._QUALITY.split(", ")]
_KINDS = {"double": pa.float64(), "int": pa.int32()}
SCORED = f"struct<clean:string,quality:struct<{','.join(f'{n}:{k}' for n, k in _MEASURES)}>>"
READ = SCORED.replace("struct<clean", f"struct<fields:{RECORD},clean", 1)


def _qualities(texts: list[str | None]) -> pa.StructArray:
    told = next(Q._quality_batches(iter([texts])))
    return pa.StructArray.from_arrays([pa.array(told[n].to_numpy(), _KINDS[k]) for n, k in _MEASURES], [n for n, _ in _MEASURES])


def _measured_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for some in batches:
        texts = some.to_pylist()
        yield pa.StructArray.from_arrays([_records(texts), _qualities(texts)], ["fields", "quality"])


def measured_record(text: Column) -> Column:
    """struct(fields, quality): record() and text_quality() of a text."""
    return F.arrow_udf(_measured_batches, READ.replace("clean:string,", ""))(text)


def _scored(read: bool) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    def batches(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in rows:
            sources, raw = some.field(0).to_pylist(), some.field(1).to_pylist()
            ocr = [s is not None and s.startswith("ocr-") for s in sources]
            units = [T._units(t) if read or o or s == "server" else None for s, t, o in zip(sources, raw, ocr, strict=True)]
            clean = ["\n".join([u[0] for u in us]) if o or s == "server" else None for s, us, o in zip(sources, units, ocr, strict=True)]
            out = [pa.array(clean, pa.string()), _qualities([c if o else t for t, c, o in zip(raw, clean, ocr, strict=True)])]
            if read:  # the server's own text is its normalised one, which is normalised again
                out.insert(0, _records([_labelled(c) if s == "server" else "\n".join([u[1] for u in us]) for s, c, us in zip(sources, clean, units, strict=True)]))
            yield pa.StructArray.from_arrays(out, ["fields", "clean", "quality"][3 - len(out) :])

    # the hints tell Spark that it is an iterator over batches
    batches.__annotations__ = {"rows": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return batches


def scored(source: Column, raw_text: Column, read: bool = False) -> Column:
    """struct(clean, quality) of a reading, with `fields` before them if read: its normalised text, of the server's and of OCR readings only;
    the quality of the text that is scored; and the record of its normalised raw text. One helper, so that a text goes to Python once."""
    return F.arrow_udf(_scored(read), READ if read else SCORED)(F.struct(source.alias("source"), raw_text.alias("raw_text")))
