"""What a line tells by itself, by one vectorised helper which looks at each different line once a worker: certificates say the
same lines again and again. Whatever needs several lines (sections, entries, replay, history) is made of the marks by built-in functions.

The helpers of a line are those of `predicates` and `events`, which stay the form for SQL and single columns; a test holds both equal.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P

MARK = "array<struct<line:string,bits:bigint,purpose:string,cause:string,owners:array<string>,persons:array<string>>>"
_MARK = pa.struct([("line", pa.string()), ("bits", pa.int64()), ("purpose", pa.string()), ("cause", pa.string()), ("owners", pa.list_(pa.string())), ("persons", pa.list_(pa.string()))])

ENTRY_START = "start of an entry"
RECEIPT_CHARS = rf"^[第号0-9{P.WS_CHARS}]+\z"
CAUSE_LABEL = "^原因"
PURPOSE = "所有権|持分一部移転"
SHARE = f"持分{P.WS}*[0-9]+分の[0-9]"
#: Without any of these in its lines, what is told of an entry that has a purpose is no noise and is plausible.
DOUBTFUL = "|".join(x.replace("BRd Ana", "Ana") for x in P.HISTORY_REJECT.removesuffix(f"|{P.HISTORY_NOISE}").split("|")) + r"|[A-Za-z]{4}|\x{FFFD}|(.)\1{6,}"
_PATTERNS = (
    P.TITLE_START, "権利部", "甲区", "乙区", P.COLLATERAL, P.TITLE_STOP, P.EXCLUDED_RIGHTS, P.HEADER, *P.TITLE_LABELS, RECEIPT_CHARS, CAUSE_LABEL, PURPOSE, SHARE, DOUBTFUL,
    "持分一部移転", "所有権一部移転", "所有権", "共有者|持分", "第", P.INVALID_WORDS, P.OWNERSHIP_WORDS, P.EVENT_WORDS,
)
#: The bit of each pattern that a mark tells of.
BITS = {p: 1 << k for k, p in enumerate(dict.fromkeys((*_PATTERNS, ENTRY_START)))}


def has(bits: Column, *patterns: str) -> Column:
    """Whether any of the patterns is found in the line, or lines, that the bits are of."""
    return bits.bitwiseAND(F.lit(sum(BITS[p] for p in set(patterns))).cast("long")) != 0


def first_marked(marks: Column, pattern: str, missing: Column | int = -1) -> Column:
    """first_line_index() of marks, for a pattern with a bit."""
    at = F.array_position(F.transform(marks, lambda m: has(m["bits"], pattern)), True).cast("int")
    return F.when(at > 0, at - 1).otherwise(missing if isinstance(missing, Column) else F.lit(missing))


def _java(pattern: str) -> re.Pattern:
    """The pattern as Java reads it: its dot stands for no line end of Unicode either."""
    dot = r"[^\n\r\x85\u2028\u2029]"
    return re.compile(P.python_pattern(pattern).replace("(.)", f"({dot})").replace(".*", f"{dot}*"))


@lru_cache(maxsize=1)
def _looks() -> dict[str, re.Pattern]:
    """Compiled once a worker."""
    more = {
        "clean": P.CLEAN_JAVA, "front": f"^[:：・\\-{P.WS_CHARS}]+", "blanks": P.WS + "{2,}", "blank": P.WS, "solid": f"[^{P.WS_CHARS}]", "letter": f"[{P.KANJI_KANA_CHARS}a-zA-Z0-9]", "run": r"(.)\1{6,}",
        "short": r"^[a-zA-Z0-9]{1,2}\z", "word": "[A-Za-z]{4}", "start": f"^順位番号{P.WS}*[0-9]+|^第?[0-9]+{P.WS}*(?:号|番)|所有権移転|所有権一部移転|持分一部移転", "number": f"^[0-9]+{P.WS}+", "event": "原因|登記",
        "aim": f"^登記の目的{P.WS}*[:：]?", "aims": "(所有権保存|所有権一部移転|所有権移転|持分一部移転|所有権)", "cause": f"^原因{P.WS}*[:：]?", "holder": f"^(所有者|権利者その他事項|権利者|共有者|氏名){P.WS}*[:：]?",
        "inline": f"(?:所有者|権利者|共有者){P.WS}*[:：]?{P.WS}*([^{P.WS_CHARS}]+)", "holders": "所有者|権利者|共有者|氏名", "annotation": "(?:持分|住所|受付).*", "no_owner": "^(持分|住所|受付|順位|原因|記載)", "digits": "[0-9]{3,}",
        "signs": r"[A-Za-z%@|｜*_~#=+<>\\]", "ascii": r"[A-Za-z*]", "symbol": r"[%@|｜*_~#=+<>\\]",
    }
    return {k: _java(p) for k, p in more.items()} | {p: _java(p) for p in (*BITS, P.PLAIN_JAVA, P.JAPANESE, P.ALNUM, P.SYMBOL, P.CAPITALS_OR_WORD5_JAVA, P.WORD4_JAVA, P.CORPORATION, P.PERSON, P.NOT_PERSON, P.OWNER_REJECT)}


_DASHES = str.maketrans("|｜()（）【】「」『』‐‑‒–—―", " " * 12 + "-" * 6)


def _clean(x: str) -> str:
    r = _looks()
    return x if r["clean"].search(x) else r["blanks"].sub(" ", r["front"].sub("", x.translate(_DASHES))).strip(P.BLANKS)


def _noise(x: str) -> bool:
    r = _looks()
    return x == "" or not r["letter"].search(x) or bool(len(x) > 6 and r["run"].search(x)) or bool(r["short"].search(x))


def _garbage(t: str) -> bool:
    r = _looks()
    if r[P.JAPANESE].search(t) and not r["word"].search(t):
        return False
    c = r["blank"].sub("", t)
    share = lambda p: len(r[p].findall(c)) / max(len(c), 1)
    foreign = (len(c) >= 6 and share(P.ALNUM) >= 0.55) or share(P.SYMBOL) >= 0.35 or r[P.CAPITALS_OR_WORD5_JAVA].search(t)
    return c == "" or bool(not r[P.JAPANESE].search(c) and foreign) or (len(r[P.WORD4_JAVA].findall(t)) >= 2 and share(P.ALNUM) >= 0.35)


def _plausible(x: str) -> bool:
    r = _looks()
    if r[P.PLAIN_JAVA].search(x):
        return not (len(x) > 6 and r["run"].search(x))
    return not _noise(x) and "\ufffd" not in x and not _garbage(x)


def _person(x: str) -> bool:
    r = _looks()
    return bool(r[P.PERSON].search(x)) and not r["digits"].search(x) and not r[P.NOT_PERSON].search(x)


def _noisy(x: str, signs: str, limit: float) -> bool:
    r = _looks()
    c = r["blank"].sub("", x)
    return len(r[signs].findall(c)) / max(len(c), 1) > limit if r[signs].search(x) else c == ""


def _safe_owner(text: str) -> str:
    r = _looks()
    x = _clean(text)
    if r["annotation"].search(x):
        x = r["annotation"].sub("", x).strip(P.BLANKS)
    corporation = bool(r[P.CORPORATION].search(x))
    rejected = (
        x == "" or len(x) > 40 or ("会社" in x and not corporation) or r[P.OWNER_REJECT].search(x)
        or (r["signs"].search(x) and (_noisy(x, "ascii", 0.12) or _noisy(x, "symbol", 0.02))) or not _plausible(x)
    )
    return "" if rejected or not (corporation or _person(x)) else x


def _owners(line: str) -> list[str]:
    """The safe owners that a line names after a holder's label, each once."""
    r = _looks()
    if not r["holders"].search(line) or "OCR候補" in line or r[P.HEADER].search(line) or r[P.EXCLUDED_RIGHTS].search(line) or not _plausible(_clean(line)):
        return []
    value = r["holder"].sub("", line).strip(P.BLANKS)
    named = [value, *map(_clean, re.split("[／/]", value))] if value else []
    safe = (_safe_owner(y) for x in (*named, *r["inline"].findall(line)) if (y := _clean(x)))
    return list(dict.fromkeys(y for x in safe if x and not r["no_owner"].search(x) and (r[P.CORPORATION].search(x) or _person(_clean(x))) and (y := _clean(x))))


def _mark(raw: str) -> tuple | None:
    """The mark of a line as it is in the text, none of noise."""
    r = _looks()
    line = _clean(raw)
    if _noise(line):
        return None
    bits = sum(bit for p, bit in BITS.items() if r[p].search(line))
    if (r["start"].search(line) or (r["number"].search(line) and r["event"].search(line))) and not r[P.HEADER].search(line):
        bits |= BITS[ENTRY_START]
    purpose = cause = None
    if bits & BITS[PURPOSE]:
        aim = r["aims"].search(_clean(r["aim"].sub("", line)))
        purpose = aim[1] if aim else ""
    if bits & BITS[CAUSE_LABEL]:
        told = r["cause"].sub("", line)
        cause = _clean(told) if told else None
    owners = _owners(line)
    return line, bits, purpose, cause, owners, [x for x in owners if _person(_clean(x)) and not r[P.CORPORATION].search(x)]


_KEPT_LINE = 200  # characters up to which a line's mark is kept
_kept_mark = lru_cache(maxsize=1 << 16)(_mark)


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    ends, flat = [0], []
    for v in values:
        flat += v
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), _structs(flat) if kind is _MARK else pa.array(flat, kind))


def _structs(marks: list[tuple]) -> pa.StructArray:
    line, bits, purpose, cause, owners, persons = zip(*marks, strict=True) if marks else ((),) * 6
    text = lambda values: pa.array(values, pa.string())
    return pa.StructArray.from_arrays([text(line), pa.array(bits, pa.int64()), text(purpose), text(cause), _lists(owners, pa.string()), _lists(persons, pa.string())], fields=list(_MARK))


def _mark_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        found = [[_kept_mark(x) if len(x) <= _KEPT_LINE else _mark(x) for x in (t or "").split("\n")] for t in texts.to_pylist()]
        yield _lists([[m for m in ms if m is not None] for ms in found], _MARK)


def marked(text: Column) -> Column:
    """The marks of a text's lines, in order, noise left out: line_array() with what each line tells."""
    return F.arrow_udf(_mark_batches, MARK)(text)
