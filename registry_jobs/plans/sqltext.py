"""DuckDB text for the expressions of registry_jobs.functions: what the registered queries are held against."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from registry_jobs.functions import patterns as P

_names = count()
WORD4 = r"\b[A-Za-z]{4,}\b"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def let(x: str, body: Callable[[str], str]) -> str:
    v = f"v{next(_names)}"
    return f"list_transform([{x}], lambda {v}: {body(v)})[1]"


def sub(x: str, pattern: str, to: str, options: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(to)}, '{options}')"


def has(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def n_of(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(pattern)})) AS BIGINT)"


def trim(x: str) -> str:
    return sub(x, f"^{P.WS}+|{P.WS}+\\z", "")


def compact(x: str) -> str:
    return sub(x, P.WS, "")


def fold(x: str) -> str:
    return f"translate({x}, chr(13) || chr(12288) || '０１２３４５６７８９㎡m²㎥｜|', chr(10) || ' 0123456789㎡㎡㎡㎡  ')"


def separators(x: str) -> str:
    return sub(x, f"([0-9]){P.WS}*[=:]{P.WS}*([0-9])", r"\1-\2")


def collapse(x: str) -> str:
    return sub(sub(x, r"([0-9]+)\)", r"\1"), P.WS + "{2,}", " ")


def despace(line: str) -> str:
    """Look-ahead isn't at hand: both sides are captured and each step is applied twice."""
    j = P.JOINED_CHARS
    for left, right in ((f"[{j}]", f"[{j}]"), (f"[{j}]", "[0-9]"), ("[0-9]", "[0-9]"), ("[0-9]", "[年月日番号]"), ("[年月日番号]", "[0-9]")):
        for _ in range(2):
            line = sub(line, f"({left}){P.WS}+({right})", r"\1\2")
    return trim(sub(line, P.WS + "{2,}", " "))


def vocabulary(x: str, rules=P.VOCABULARY) -> str:
    for variants, term, _ in rules:
        x = sub(x, P.spaced(variants), term)
    return x


def labels(x: str) -> str:
    for variants, label in P.LABEL_RULES:
        x = sub(x, P.spaced(variants), label)
    return x


def by_line(x: str, body: Callable[[str], str], sep: str = "chr(10)") -> str:
    return f"array_to_string(list_transform(string_split({x}, {sep}), lambda u: {body('u')}), chr(10))"


def repair_line(line: str) -> str:
    """Look-around isn't at hand: what stands around a letter is captured, and where it may be shared the step is applied twice."""
    x = sub(line, "[§ＳS]([0-9])", r"5\1")
    for chars, digit in (("[§ＳS]", "5"), ("B", "8"), ("[Il|｜]", "1"), ("O", "0")):
        for _ in range(2):
            x = sub(x, f"([0-9]){chars}([0-9号番\\-]|\\z)", rf"\1{digit}\2")
    w = P.WS
    x = separators(sub(x, f"第{w}*([0-9]+){w}+([0-9]+){w}*号", r"第\1\2号"))
    x = sub(x, f"([0-9]){w}+([0-9]){w}*分{w}*の{w}*([0-9])", r"\1\2分の\3")
    return when(has(line, P.NUMBER_CONTEXT), sub(x, f"([0-9]+){w}*分{w}*の{w}*([0-9]+)", r"\1分の\2"), line)


def chain(x: str) -> str:
    return vocabulary(sub(by_line(x, repair_line), f"(所在{P.WS}*)都山市", r"\1郡山市"))


def normal_ocr(x: str) -> str:
    return trim(sub(chain(by_line(chain(collapse(separators(fold(f"coalesce({x}, '')")))), despace)), "\\n{2,}", "\n"))


def normal(x: str) -> str:
    """What extraction reads."""
    folded = f"translate({sub(normal_ocr(x), '[ \\t]+', ' ')}, chr(13) || chr(12288) || '０１２３４５６７８９㎡m²㎥', chr(10) || ' 0123456789㎡㎡㎡㎡')"
    return labels(trim(sub(folded, "\\n{2,}", "\n")))


def counted(source: str, keys: str, number_label: str, place_label: str) -> str:
    """CTEs over a relation `source(keys..., text)`: `rep` has the normalised text and, in `ns`, the matches of every step of both passes, with their labels in `names`."""
    front = collapse(separators(fold("coalesce(text, '')")))
    steps = [f"p0 AS MATERIALIZED (SELECT {keys}, {front} AS t, CAST([] AS BIGINT[]) AS ns FROM {source})"]
    names, k = [], 0

    def step(text: str, n: str, name: str) -> None:
        nonlocal k
        k += 1
        names.append(name)
        steps.append(f"p{k} AS MATERIALIZED (SELECT {keys}, {text} AS t, list_append(ns, {n}) AS ns FROM p{k - 1})")

    for turn in range(2):
        if turn:
            steps.append(f"pd AS MATERIALIZED (SELECT {keys}, {by_line('t', despace)} AS t, ns FROM p{k})")
            steps.append(f"p{k + 1} AS MATERIALIZED (SELECT {keys}, t, ns, {by_line('t', repair_line)} AS u FROM pd)")
        else:
            steps.append(f"p{k + 1} AS MATERIALIZED (SELECT {keys}, t, ns, {by_line('t', repair_line)} AS u FROM p{k})")
        k += 1
        step("u", "len(list_filter(list_zip(string_split(t, chr(10)), string_split(u, chr(10))), lambda z: z[1] <> z[2]))", number_label)
        moved = sub("t", f"(所在{P.WS}*)都山市", r"\1郡山市")
        step(moved, f"CAST(t <> {moved} AS BIGINT)", place_label)
        for variants, term, label in P.VOCABULARY:
            step(sub("t", P.spaced(variants), term), n_of("t", P.spaced(variants)), label)
    held = "[" + ", ".join(q(n) for n in names) + "]"
    done = trim(sub("t", "\\n{2,}", "\n"))
    return ",\n".join(steps) + f",\nrep AS MATERIALIZED (SELECT {keys}, {done} AS text, ns FROM p{k}), " + (
        f"cor AS MATERIALIZED (SELECT {keys}, label, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {keys}, unnest({held}) AS label, unnest(ns) AS n FROM rep) WHERE n > 0 GROUP BY ALL)"
    )


def clean(x: str) -> str:
    x = f"translate({x}, '|｜()（）【】「」『』‐‑‒–—―', '            ------')"
    return trim(sub(sub(x, f"^[:：・\\-{P.WS_CHARS}]+", ""), P.WS + "{2,}", " "))


def noise_cleaned(x: str) -> str:
    """Without the test for one character seven times over, which RE2 can't say; the frames hold no such line."""
    return f"({x} = '' OR NOT {has(x, f'[{P.KANJI_KANA_CHARS}a-zA-Z0-9]')} OR {has(x, '^[a-zA-Z0-9]{1,2}\\z')})"


def garbage(x: str) -> str:
    def of(c: str, t: str) -> str:
        foreign, n = f"NOT {has(c, P.JAPANESE)}", f"greatest(length({c}), 1)"
        return (
            f"({c} = '' OR ({foreign} AND length({c}) >= 6 AND {n_of(c, P.ALNUM)} / {n} >= 0.55) OR ({foreign} AND {n_of(c, P.SYMBOL)} / {n} >= 0.35) "
            f"OR ({n_of(t, WORD4)} >= 2 AND {n_of(c, P.ALNUM)} / {n} >= 0.35) OR ({foreign} AND {has(t, '[A-Z]{4,}|\\b[a-z]{5,}\\b')}))"
        )

    return let(x, lambda t: let(compact(t), lambda c: of(c, t)))


def plausible_cleaned(x: str) -> str:
    return f"(NOT {noise_cleaned(x)} AND NOT contains({x}, chr(65533)) AND NOT {garbage(x)})"


def plausible(x: str) -> str:
    return let(clean(x), plausible_cleaned)


def noisy(x: str, pattern: str, limit: float) -> str:
    return let(compact(x), lambda c: f"({c} = '' OR {n_of(c, pattern)} / greatest(length({c}), 1) > {limit})")


def ascii_noise(x: str, limit: float) -> str:
    return noisy(x, "[A-Za-z*]", limit)


def symbol_noise(x: str, limit: float) -> str:
    return noisy(x, r"[%@|｜*_~#=+<>\\]", limit)


def when(test: str, then: str, otherwise: str = "''") -> str:
    return f"CASE WHEN {test} THEN {then} ELSE {otherwise} END"


def safe_location(x: str) -> str:
    return let(
        clean(x),
        lambda v: when(
            f"{v} <> '' AND {plausible_cleaned(v)} AND {has(v, P.JAPANESE)} AND NOT {ascii_noise(v, 0.18)} AND NOT {symbol_noise(v, 0.08)} AND NOT {has(v, P.NOISE_TOKENS)} "
            f"AND NOT {has(v, P.CONTAMINATION)} AND NOT {has(v, P.LOCATION_REJECT)}",
            v,
        ),
    )


def safe_number(x: str) -> str:
    return let(clean(x), lambda v: when(f"{v} <> '' AND {has(v, f'^(?:{P.LOT_NUMBER})\\z')} AND NOT {garbage(v)}", v))


def normalize_area(x: str) -> str:
    found = lambda v: f"regexp_extract({v}, {q(f'([0-9]+(?:\\.[0-9]+)?){P.WS}*㎡')}, 1)"
    return let(f"replace({clean(x)}, '平方メートル', '㎡')", lambda v: when(f"{found(v)} <> ''", f"{found(v)} || '㎡'", v))


def safe_area(x: str) -> str:
    return let(normalize_area(x), lambda v: when(has(v, r"^[0-9]{1,7}(?:\.[0-9]{1,2})?㎡\z"), v))


def corp(x: str) -> str:
    return has(x, P.CORPORATION)


def person(x: str) -> str:
    return let(clean(x), lambda v: f"({v} <> '' AND NOT {has(v, '[0-9]{3,}')} AND NOT {has(v, P.NOT_PERSON)} AND {has(v, P.PERSON)})")


def safe_owner(x: str) -> str:
    stripped = clean(x)
    for word in ("持分", "住所", "受付"):
        stripped = sub(stripped, f"{word}.*", "")

    def of(v: str) -> str:
        reject = [f"{v} = ''", f"NOT {plausible(v)}", has(v, P.HEADER), has(v, P.CONTAMINATION), has(v, P.ADDRESS), ascii_noise(v, 0.12), symbol_noise(v, 0.02), has(v, P.NOISE_TOKENS), f"contains({v}, 'OCR候補')"]
        reject += [has(v, P.OWNER_DATES), has(v, P.OWNER_EVENTS), f"(contains({v}, '会社') AND NOT {corp(v)})", f"length({v}) > 40"]
        return when(f"NOT ({' OR '.join(reject)}) AND ({corp(v)} OR {person(v)})", v)

    return let(trim(stripped), of)


def history_noise(x: str) -> str:
    return let(clean(x), lambda v: f"({v} = '' OR {has(v, P.HEADER)} OR {has(v, P.EXCLUDED_RIGHTS)} OR {has(v, P.NOISE_TOKENS)} OR {has(v, P.HISTORY_NOISE)} OR {garbage(v)})")


def unique_clean(x: str) -> str:
    """First occurrences in order of the cleaned values that hold something."""
    return let(f"list_filter(list_transform({x}, lambda u: {clean('u')}), lambda u: u <> '')", lambda v: f"list_filter({v}, lambda u, i: list_position({v}, u) = i)")


def first_index(lines: str, pattern: str, missing: str = "-1") -> str:
    return let(lines, lambda l: f"coalesce(list_position(list_transform({l}, lambda u: {has('u', pattern)}), true) - 1, {missing})")


def cut(lines: str, begin: str, end: str) -> str:
    return f"CASE WHEN ({end}) > ({begin}) THEN {lines}[({begin}) + 1:({end})] ELSE CAST([] AS VARCHAR[]) END"


def cut_at(lines: str, pattern: str) -> str:
    return let(lines, lambda l: cut(l, "0", first_index(l, pattern, f"len({l})")))


def value_after_label(line: str, label: str) -> str:
    stops = [w for w in (*P.TITLE_LABELS, *P.OTHER_LABELS, *P.SECTION_WORDS) if w != label]
    ends = lambda a: "least(" + ", ".join(f"CASE WHEN instr({a}, '{w}') > 0 THEN instr({a}, '{w}') END" for w in stops) + f", length({a}) + 1)"
    return let(line, lambda x: when(f"contains({x}, '{label}')", let(f"substr({x}, instr({x}, '{label}') + {len(label)})", lambda a: clean(f"substr({a}, 1, {ends(a)} - 1)"))))


def following(lines: str, at: str, label: str, ahead: int) -> str:
    others = "|".join(w for w in P.TITLE_LABELS if w != label)
    return cut_at(f"{lines}[{at} + 2:{at} + 1 + {ahead}]", f"^(?:{others}|権利部|甲区|乙区)")


def first_of(values: str) -> str:
    return f"coalesce(list_filter({values}, lambda u: u <> '')[1], '')"


def label_value(lines: str, label: str, ahead: int) -> str:
    def of(l: str, i: str) -> str:
        more = clean(f"array_to_string(list_filter({following(l, i, label, ahead)}, lambda u: {plausible('u')}), ' ')")
        return when(f"{i} < 0", "''", let(value_after_label(f"{l}[{i} + 1]", label), lambda v: when(f"{v} <> '' AND {plausible(v)}", v, more)))

    return let(lines, lambda l: let(first_index(l, label), lambda i: of(l, i)))


def inline_row(lines: str, label: str) -> str:
    good = lambda v: when(f"{v} <> '' AND {plausible(v)}", v)

    def cell(line: str) -> str:
        cells = f"list_filter(list_transform(string_split_regex({line}, {q(P.WS + '+')}), lambda w: {clean('w')}), lambda w: w <> '')"
        return let(cells, lambda c: f"coalesce(CASE WHEN list_contains({c}, '{label}') THEN {c}[list_position({c}, '{label}') + 1] END, '')")

    of = lambda line: let(let(value_after_label(line, label), good), lambda v: when(f"{v} <> ''", v, let(cell(line), good)))
    return first_of(f"list_transform(list_filter({lines}, lambda r: contains(r, '{label}')), lambda r: {of('r')})")


def area_by_label(lines: str, label: str, ahead: int) -> str:
    def of(l: str, i: str) -> str:
        more = first_of(f"list_transform({following(l, i, label, ahead)}, lambda r: {safe_area('r')})")
        return when(f"{i} < 0", "''", let(safe_area(value_after_label(f"{l}[{i} + 1]", label)), lambda v: when(f"{v} <> ''", v, more)))

    return let(lines, lambda l: let(first_index(l, label), lambda i: of(l, i)))


def location(title: str) -> str:
    fallback = safe_location(f"coalesce(list_filter({title}, lambda r: {has('r', '[都道府県].*?[市区町村]')})[1], '')")
    return let(first_of(f"[{safe_location(inline_row(title, '所在'))}, {safe_location(label_value(title, '所在', 6))}]"), lambda v: when(f"{v} <> ''", v, fallback))


def lot_number(title: str) -> str:
    take = lambda x: f"regexp_extract({clean(x)}, {q(f'({P.LOT_NUMBER})')}, 1)"
    joined = f"array_to_string({title}, ' ')"
    scan = when(has(joined, P.LAND_WORDS), f"regexp_extract({joined}, {q(f'({P.LOT_NUMBER_MARKED})')}, 1)")
    return let(first_of(f"[{take(inline_row(title, '地番'))}, {take(label_value(title, '地番', 5))}]"), lambda v: safe_number(when(f"{v} <> ''", v, scan)))


def land_area(title: str, lines: str) -> str:
    return first_of(f"[{area_by_label(title, '地積', 5)}, {area_by_label(lines, '地積', 2)}]")


def building_area(title: str, lines: str) -> str:
    return first_of("[" + ", ".join(area_by_label(x, label, n) for x, n in ((title, 5), (lines, 2)) for label in ("床面積", "建物面積")) + "]")


def quality(text: str, name: str = "q") -> str:
    """CTEs over a relation `texts(id..., text)`: quality columns of each row. Spark's struct as plain columns."""
    c = compact("text")
    label = lambda x: has("text", (P.WS + "*").join([x[0], x[1:]] if "[" in x else list(x)))
    line_garbage = let(
        compact("u"),
        lambda v: f"(length({v}) >= 4 AND ((NOT {has(v, P.JAPANESE)} AND ({n_of(v, P.ALNUM)} >= length({v}) * 0.55 OR {n_of(v, P.SYMBOL)} >= length({v}) * 0.35)) OR {n_of('u', WORD4)} >= 2))",
    )
    lines = f"list_filter(list_transform(string_split_regex(text, '\\n+'), lambda u: {trim('u')}), lambda u: u <> '')"
    return (
        f"{name}0 AS (SELECT *, {c} AS c, {lines} AS ls, {' + '.join(f'CAST({label(x)} AS INTEGER)' for x in P.QUALITY_LABELS)} AS label_count, {n_of('text', WORD4)} AS words FROM {text}), "
        f"{name}1 AS (SELECT *, length(c) AS length, greatest(length(c), 1) AS n, {n_of('c', P.JAPANESE)} AS jp, {n_of('c', P.ALNUM)} AS asc_, {n_of('c', P.SYMBOL)} AS sym, len(ls) AS line_count, len(list_filter(ls, lambda u: {line_garbage})) AS garbage_lines FROM {name}0), "
        f"{name} AS (SELECT *, jp / n AS japanese_ratio, (asc_ + sym) / n AS noise_ratio, least(length / 6.0::DOUBLE, 45.0::DOUBLE) + jp / n * 80 + label_count * 22 - asc_ / n * 35 - sym / n * 35 - words * 8 - garbage_lines * 15 AS score FROM {name}1)"
    )


STRONG = "(score >= 85 AND label_count >= 3 AND garbage_lines <= 2)"
USABLE = (
    "(length >= 40 AND label_count >= 1 AND japanese_ratio >= 0.18 AND garbage_lines < 8 AND CASE WHEN starts_with(source, 'ocr-') THEN score >= 55 AND label_count >= 2 AND garbage_lines <= 3 ELSE score >= 45 END)"
)
PREVIEWABLE = "(length >= 20 AND NOT (line_count > 0 AND garbage_lines >= greatest(10.0, line_count * 0.8)) AND (score >= 5 OR label_count >= 1 OR japanese_ratio >= 0.05))"
PREVIEW = "(score + least(length / 8.0::DOUBLE, 60.0::DOUBLE) + label_count * 12 - garbage_lines * 6)"
