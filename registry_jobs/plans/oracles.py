"""The registered questions in DuckDB's SQL, over the given tables."""

from __future__ import annotations

from registry_jobs.functions import patterns as P
from registry_jobs.operators.diagnostics import REASONS
from registry_jobs.operators.images import TONES
from registry_jobs.operators.templates import TEMPLATES
from registry_jobs.plans import fixtures as X
from registry_jobs.plans import sqltext as S
from registry_jobs.sources import exports as E

NONE = "CAST([] AS VARCHAR[])"
DOCS = f"WITH {X.REG_DOCS_SQL}"
NOISY = f"WITH {X.REG_NOISY_SQL}"
LINES = f"{DOCS}, ll AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda u: {S.clean('u')}), lambda u: NOT {S.noise_cleaned('u')}) AS ls FROM reg_docs)"
LONG = f"{LINES}, lo AS (SELECT doc_id, CAST(unnest(range(0, len(ls))) AS INTEGER) AS line_no, unnest(ls) AS line FROM ll)"
SECTIONS = f"""{LINES},
sp AS (SELECT doc_id, ls, len(ls) AS n, {S.first_index("ls", P.TITLE_START, "0")} AS ti, {S.first_index("ls", "権利部")} AS ri, {S.first_index("ls", "甲区")} AS ki FROM ll),
sr AS (SELECT *, CASE WHEN ri >= 0 THEN ri WHEN ki >= 0 THEN ki ELSE least(n, ti + 120) END AS rs FROM sp),
st AS (SELECT doc_id, ls, {S.cut("ls", "ti", "CASE WHEN rs > ti THEN rs ELSE n END")} AS raw_title, {S.cut("ls", "rs", "n")} AS rights FROM sr),
sk AS (SELECT doc_id, ls, {S.cut_at("raw_title", P.TITLE_STOP)} AS title, rights, len(rights) AS n, {S.first_index("rights", "甲区")} AS k, {S.first_index("rights", "乙区")} AS o, {S.first_index("rights", P.COLLATERAL)} AS c FROM st),
sx AS (SELECT *, CASE WHEN k >= 0 AND o >= 0 AND k < o THEN {S.cut("rights", "k", "o")} WHEN k >= 0 AND o >= 0 THEN {S.cut("rights", "k", "n")}
        WHEN k >= 0 THEN {S.cut("rights", "k", "CASE WHEN c > k THEN c ELSE n END")} ELSE rights END AS raw_kouku,
      CASE WHEN k >= 0 AND o >= 0 AND k < o THEN {S.cut("rights", "o", "CASE WHEN c > o THEN c ELSE n END")} WHEN k >= 0 AND o >= 0 THEN {S.cut("rights", "o", "k")} ELSE {NONE} END AS otsuku,
      CASE WHEN c >= 0 THEN {S.cut("rights", "c", "n")} ELSE {NONE} END AS collateral FROM sk),
ss AS (SELECT doc_id, ls, title, rights, {S.cut_at("raw_kouku", P.EXCLUDED_RIGHTS)} AS kouku, otsuku, collateral FROM sx)"""
START = (
    f"(NOT {S.has('line', P.HEADER)} AND ({S.has('line', f'^順位番号{P.WS}*[0-9]+')} OR {S.has('line', f'^第?[0-9]+{P.WS}*(号|番)')} OR {S.has('line', '所有権移転|所有権一部移転|持分一部移転')} "
    f"OR ({S.has('line', f'^[0-9]+{P.WS}+')} AND {S.has('line', '原因|登記')})))"
)
BLOCKS = f"""{SECTIONS},
kl AS (SELECT doc_id, unnest(range(0, len(kouku))) AS i, unnest(kouku) AS line FROM ss),
kb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM kl WHERE NOT {S.has("line", "甲区|権利部")} AND NOT {S.has("line", P.HEADER)}),
kn AS (SELECT *, sum(CASE WHEN r = 1 OR {START} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM kb)"""
ENTRIES = f"""{BLOCKS},
bl AS (SELECT doc_id, block, list(line ORDER BY i) AS lines FROM kn GROUP BY doc_id, block),
bf AS (SELECT *, {S.has(S.compact("array_to_string(lines, ' ')"), "^第?[0-9]+号\\z")} AS flag, max(block) OVER (PARTITION BY doc_id) AS last FROM bl),
bg AS (SELECT *, sum(CASE WHEN flag THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY block) AS grp FROM bf),
bp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, grp, flag ORDER BY block) AS rp FROM bg),
bm AS (SELECT doc_id, CASE WHEN flag AND rp % 2 = 1 AND block < last THEN block + 1 ELSE block END AS target, block, lines FROM bp),
bn AS (SELECT doc_id, target, flatten(list(lines ORDER BY block)) AS lines FROM bm GROUP BY doc_id, target),
e0 AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY target) - 1 AS INTEGER) AS entry_no, lines FROM bn)"""


def first_line(pattern: str) -> str:
    return f"coalesce(list_filter(lines, lambda u: {S.has('u', pattern)})[1], '')"


def _owners() -> str:
    holder = f"^(所有者|権利者その他事項|権利者|共有者|氏名){P.WS}*[:：]?"
    named = S.when(
        S.has("u", "所有者|権利者|共有者|氏名"),
        S.let(S.trim(S.sub("u", holder, "")), lambda v: S.when(f"{v} <> ''", f"list_concat([{v}], list_transform(string_split_regex({v}, '[／/]'), lambda w: {S.clean('w')}))", NONE)),
        NONE,
    )
    inline = f"regexp_extract_all(u, {S.q(f'(?:所有者|権利者|共有者){P.WS}*[:：]?{P.WS}*([^{P.WS_CHARS}]+)')}, 1)"
    fit = f"list_filter(lines, lambda u: {S.plausible('u')} AND NOT {S.has('u', P.HEADER)} AND NOT {S.has('u', P.EXCLUDED_RIGHTS)} AND NOT contains(u, 'OCR候補'))"
    raw = S.unique_clean(f"flatten(list_transform({fit}, lambda u: list_concat({named}, {inline})))")
    safe = f"list_filter(list_transform({raw}, lambda u: {S.safe_owner('u')}), lambda u: u <> '')"
    return S.unique_clean(f"list_filter({safe}, lambda u: NOT {S.has('u', '^(持分|住所|受付|順位|原因|記載)')} AND ({S.corp('u')} OR {S.person('u')}))")


JOINED = "(cause || ' ' || array_to_string(lines, ' '))"
PARSED = f"""{ENTRIES},
e1 AS (SELECT *, regexp_extract({S.clean(S.sub(first_line("所有権|持分一部移転"), f"^登記の目的{P.WS}*[:：]?", ""))}, '(所有権保存|所有権一部移転|所有権移転|持分一部移転|所有権)', 1) AS purpose,
    {S.clean(S.compact(f"regexp_extract(array_to_string(lines, ' '), {S.q(f'(第{P.WS}*[0-9]{{1,8}}{P.WS}*号)')}, 1)"))} AS receipt,
    {S.let(S.sub(first_line("^原因"), f"^原因{P.WS}*[:：]?", ""), lambda d: S.clean(S.when(f"{d} <> ''", d, first_line(P.EVENT_WORDS))))} AS cause,
    {_owners()} AS owners FROM e0),
e2 AS (SELECT *, CASE WHEN contains(pl, '持分一部移転') THEN 'sharePartial' WHEN contains(pl, '所有権一部移転') THEN 'partial' WHEN contains(pl, '所有権') THEN 'full' ELSE 'unknown' END AS event_type,
    {S.has(JOINED, P.INVALID_WORDS)} AS invalid, {S.has(JOINED, P.OWNERSHIP_WORDS)} AS ownership_event,
    replace(coalesce(list_filter(list_transform(lines, lambda u: regexp_extract(u, {S.q(f"持分{P.WS}*[0-9]+分の[0-9]+")})), lambda u: u <> '')[1], ''), ' ', '') AS share,
    {S.unique_clean(f"list_filter(owners, lambda u: {S.person('u')} AND NOT {S.corp('u')})")}[1:12] AS persons
    FROM (SELECT *, purpose || ' ' || array_to_string(lines, ' ') AS pl FROM e1)),
en AS (SELECT *, event_type IN ('partial', 'sharePartial') OR len(list_filter(lines, lambda u: contains(u, '共有者') OR contains(u, '持分'))) > 0 AS shared FROM e2)"""


def parts(separator: str, *items: tuple[str, str]) -> str:
    return f"array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {t} END' for c, t in items)}], lambda u: u IS NOT NULL), '{separator}')"


def history_clean(x: str) -> str:
    return S.trim(S.sub(S.sub(S.clean(x), f"権利者:{P.WS}*([^|]+?){P.WS}*持分", r"権利者: \1 持分"), P.WS + "{2,}", " "))


OWNERS = "array_to_string(owners, ' / ')"
PERSONS = "array_to_string(persons, ' / ')"
SUMMARY = history_clean(
    parts(
        " / ",
        ("purpose <> ''", "purpose"),
        ("receipt <> ''", "'receipt ' || receipt"),
        ("cause <> ''", "'cause ' || cause"),
        ("len(owners) > 0", f"(CASE WHEN shared THEN 'co-owner candidate' ELSE 'owner' END) || ' ' || {OWNERS}"),
        ("shared AND len(owners) = 0", "'co-owner candidate exists'"),
        ("len(persons) > 0", f"'person OCR candidate ' || {PERSONS}"),
    )
)
HISTORY = S.let(
    history_clean(
        parts(
            " ",
            ("purpose <> ''", "purpose"),
            ("receipt <> ''", "'受付: ' || receipt"),
            ("cause <> ''", "'原因: ' || cause"),
            ("len(owners) > 0", f"(CASE WHEN shared THEN '共有者候補' ELSE '権利者' END) || ': ' || {OWNERS}"),
            ("shared AND len(owners) = 0", f"'{P.COOWNERS}'"),
            ("shared AND len(persons) > 0", f"'人名OCR候補: ' || {PERSONS}"),
            ("share <> ''", "share"),
        )
    ),
    lambda m: S.when(f"{m} <> '' AND NOT {S.has(m, P.HEADER)} AND NOT {S.has(m, P.EXCLUDED_RIGHTS)} AND NOT {S.history_noise(m)} AND {S.plausible(m)}", m),
)
REPLAY = f"""{PARSED},
v0 AS (SELECT *, list_filter(list_transform(owners, lambda u: {S.safe_owner("u")}), lambda u: u <> '') AS own FROM en WHERE ownership_event AND NOT invalid),
v1 AS (SELECT *, CASE WHEN event_type = 'full' AND shared AND len(own) >= 2 THEN 'M' WHEN (event_type = 'full' OR (event_type = 'unknown' AND len(own) > 0)) AND NOT shared THEN CASE WHEN len(own) > 0 THEN 'R' ELSE 'N' END
    WHEN event_type IN ('partial', 'sharePartial') OR shared THEN 'S' ELSE 'N' END AS kind FROM v0),
v2 AS (SELECT *, max(CASE WHEN kind IN ('R', 'M') THEN entry_no END) OVER w AS last_r, min(CASE WHEN len(list_filter(own, lambda u: contains(u, '{P.BUILDER}'))) > 0 THEN entry_no END) OVER w AS builder_at FROM v1 WINDOW w AS (PARTITION BY doc_id)),
v3 AS (SELECT doc_id, bool_or(kind = 'S') AS ambiguous, coalesce(bool_or(kind = 'S' AND entry_no >= builder_at), false) AS after FROM v2 GROUP BY doc_id),
v4 AS (SELECT doc_id, entry_no, unnest(range(0, len(own))) AS pos, unnest(own) AS name FROM v2 WHERE entry_no = last_r OR (kind = 'S' AND entry_no > coalesce(last_r, -1))),
v5 AS (SELECT doc_id, name, min(entry_no * 1000 + pos) AS place FROM v4 GROUP BY doc_id, name),
v6 AS (SELECT doc_id, list(name ORDER BY place) AS names FROM v5 GROUP BY doc_id),
state AS (SELECT doc_id, CASE WHEN after OR (ambiguous AND len(others) < 2) THEN '{P.COOWNERS}' WHEN ambiguous THEN array_to_string(others, ' / ') ELSE array_to_string(names, ' / ') END AS owner, after
    FROM (SELECT v3.*, coalesce(names, {NONE}) AS names, list_filter(coalesce(names, {NONE}), lambda u: NOT contains(u, '{P.BUILDER}')) AS others FROM v3 LEFT JOIN v6 USING (doc_id)))"""
HIST = f"""{REPLAY},
h0 AS (SELECT doc_id, list(item ORDER BY entry_no) AS items FROM (SELECT doc_id, entry_no, {HISTORY} AS item FROM en WHERE ownership_event AND NOT invalid) WHERE item <> '' GROUP BY doc_id),
h1 AS (SELECT ss.doc_id, ss.ls, {S.unique_clean(f"CASE WHEN len(coalesce(items, {NONE})) > 0 THEN items ELSE list_filter(ls, lambda r: {S.has('r', P.HISTORY_WORDS)} AND {S.plausible('r')} AND NOT {S.history_noise('r')}) END")}[1:30] AS history FROM ss LEFT JOIN h0 USING (doc_id)),
h2 AS (SELECT *, list_filter(list_transform(list_filter(ls, lambda r: {S.has("r", "所有者|権利者|共有者")}), lambda r: {S.safe_owner(S.trim(S.sub("r", f"^(所有者|権利者その他事項|権利者|共有者){P.WS}*[:：]?", "")))}), lambda r: r <> '') AS named,
    list_filter(list_transform(flatten(list_transform(history, lambda r: string_split({S.sub("r", f"^.*権利者:{P.WS}*", "")}, '/'))), lambda r: {S.safe_owner("r")}), lambda r: r <> '') AS told FROM h1),
fall AS (SELECT doc_id, history, {S.unique_clean("(CASE WHEN len(named) > 0 THEN named ELSE told END)[-2:]")} AS fallback FROM h2)"""
TITLE = f"{SECTIONS}, tf AS (SELECT doc_id, ls, title, {S.location('title')} AS location, {S.lot_number('title')} AS lot_number, {S.land_area('title', 'ls')} AS land_area, {S.building_area('title', 'ls')} AS building_area FROM ss)"
RECORD = f"""{HIST},
rc AS (SELECT ss.doc_id, ss.title, ss.otsuku, ss.collateral, {S.safe_location(S.location("title"))} AS location, {S.safe_number(S.lot_number("title"))} AS lot_number, {S.safe_area(S.land_area("title", "ss.ls"))} AS land_area, {S.safe_area(S.building_area("title", "ss.ls"))} AS building_area,
    CASE WHEN coalesce(state.owner, '') <> '' THEN state.owner WHEN state.doc_id IS NULL THEN array_to_string(list_filter(list_transform(fallback, lambda r: {S.safe_owner("r")}), lambda r: r <> ''), ' / ') ELSE '' END AS owner,
    list_filter(fall.history, lambda r: {S.plausible("r")} AND NOT {S.garbage("r")}) AS history
    FROM ss JOIN fall USING (doc_id) LEFT JOIN state USING (doc_id))"""
NORMAL_RECORD = f"{DOCS}, nd AS (SELECT doc_id, {S.normal('text')} AS text FROM reg_docs){RECORD[len(DOCS):].replace('FROM reg_docs)', 'FROM nd)')}"
READINGS = f"{NOISY}, nt AS (SELECT doc_id, source, arrival_no, raw_text AS text FROM reg_noisy), {S.quality('nt')}"
PAGES = f"WITH {X.REG_PAGES_SQL}"
ROUND = "CAST(floor({} + 0.5) AS BIGINT)"
_display = lambda x: f"CASE WHEN {S.trim(f'coalesce({x}, {chr(39)}{chr(39)})')} = '' THEN '{P.NOT_DETECTED}' ELSE {x} END"
NORMAL = (
    f"WITH {X.RECORDS_SQL}, rn AS (SELECT doc_id, "
    + ", ".join(f"coalesce(\"{n}\", '') AS \"{n}\"" for n in E.FIELDS)
    + ", coalesce(list_filter(\"ownersHistory\", lambda u: u <> ''), CAST([] AS VARCHAR[])) AS hist FROM records)"
)
_HISTORY_CELL = f"CASE WHEN len(hist) > 0 THEN array_to_string(hist, ' / ') ELSE '{P.NOT_DETECTED}' END"
_ROWS = [("'項目'", "'値'"), *((f"'{item}'", _display(f'"{n}"')) for item, n in E.REPORT_ROWS)]


def _report(rows: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, {k} AS row_no, {i} AS item, {v} AS value FROM rn" for k, (i, v) in enumerate(rows))


def _quoted(x: str) -> str:
    return f"'\"' || replace({x}, '\"', '\"\"') || '\"'"


def _fill(text: str) -> str:
    """A template of the catalogue as one concatenation: the places are known here."""
    out = S.q(text)
    for key, column in (("propertyName", "c_name"), ("location", "c_address"), ("lotNumber", "CAST(c_custkey AS VARCHAR)"), ("landArea", "''"), ("buildingArea", "''"), ("usage", "c_mktsegment"), ("owner", "c_name")):
        out = out.replace("{{" + key + "}}", f"' || {column} || '")
    return out


def _grey(contrast: float, brightness: float) -> str:
    grey = "floor(r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE + 0.5)"
    return f"CAST(least(255, greatest(0, floor(({grey} - 128) * {contrast}::DOUBLE + 128 + {brightness}::DOUBLE + 0.5))) AS INTEGER)"


GREY = f"WITH {X.PIXELS_SQL}, gp AS (SELECT image_id, y, x, {_grey(*TONES['binary'])} AS grey FROM pixels)"
OTSU = f"""{GREY}, hi AS (SELECT image_id, grey, count(*) AS n FROM gp GROUP BY ALL),
hc AS (SELECT *, sum(n) OVER (PARTITION BY image_id ORDER BY grey) AS wb, sum(grey * n) OVER (PARTITION BY image_id ORDER BY grey) AS sb, sum(n) OVER (PARTITION BY image_id) AS w, sum(grey * n) OVER (PARTITION BY image_id) AS s FROM hi),
hv AS (SELECT *, CASE WHEN w > wb THEN CAST(wb AS DOUBLE) * (w - wb) * (sb / wb - (s - sb) / (w - wb)) * (sb / wb - (s - sb) / (w - wb)) END AS v FROM hc),
th AS (SELECT image_id, CAST(least(210, greatest(70, coalesce(max_by(grey, (v, -grey)) FILTER (WHERE v > 0), 128))) AS INTEGER) AS threshold FROM hv GROUP BY image_id)"""
BINARY = f"{OTSU}, bw AS (SELECT gp.image_id, y, x, CASE WHEN grey >= threshold THEN 255 ELSE 0 END AS value FROM gp JOIN th USING (image_id))"


def _flag(expression: str, name: str = "flag") -> str:
    return f"{LONG} SELECT doc_id, line_no, {expression} AS {name} FROM lo"


def _route() -> str:
    keywords = " + ".join(f"CAST(contains(c, '{k}') AS INTEGER)" for k in P.ROUTE_KEYWORDS)
    own = (
        "CASE WHEN page_no = 1 THEN n < 160 OR (kw >= 1 AND n < 220) WHEN n >= 220 AND garble = 0 THEN false ELSE n < 60 OR garble >= 2 OR (kw >= 1 AND n < 180) END"
    )
    return f"""{PAGES}, p0 AS (SELECT doc_id, source, page_no, {S.compact("page_text")} AS c FROM reg_pages),
p1 AS (SELECT *, length(c) AS n, {keywords} AS kw, {S.n_of("c", P.GARBLE)} AS garble FROM p0), p2 AS (SELECT doc_id, source, page_no, {own} AS own FROM p1)
SELECT doc_id, source, page_no, own OR (NOT bool_or(own) OVER (PARTITION BY doc_id, source) AND page_no = 1) AS needs_ocr FROM p2"""


_BEST = f"{PAGES}, pt AS (SELECT doc_id, page_no, variant_no, source, page_text AS text FROM reg_pages), {S.quality('pt')}, bv AS (SELECT *, {S.PREVIEW} AS ps, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY {S.PREVIEW} DESC, variant_no) AS nth FROM q), win AS (SELECT * FROM bv WHERE nth = 1)"
_ADOPTED = f"{_BEST}, wi AS (SELECT doc_id, source, variant_no, count(*) AS wins FROM win GROUP BY ALL), top AS (SELECT doc_id, source FROM wi QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY wins DESC, variant_no) = 1)"
_assembled = lambda order: S.trim(f"string_agg(text, chr(10) ORDER BY {order})")
_NOISE = lambda v, limit: S.noisy(v, r"[A-Za-z%*@|｜_~#=+<>\\]", limit)


def confirmed(field: str, v: str) -> str:
    if field == "owner":
        good = f"NOT {_NOISE(v, 0.04)} AND NOT {S.has(v, P.ADDRESS)} AND (NOT contains({v}, '会社') OR {S.has(v, P.CONFIRMED_CORPORATION)}) AND {S.has(v, f'{P.CONFIRMED_CORPORATION}|{P.PERSON}')}"
    elif field == "location":
        good = f"NOT {_NOISE(v, 0.06)} AND NOT {S.has(v, P.CONFIRMED_LOCATION_REJECT)} AND {S.has(v, '[都道府県市区町村]')}"
    elif field == "lot_number":
        good = f"NOT {S.has(v, P.CONFIRMED_NUMBER_REJECT)} AND {S.has(v, P.CONFIRMED_NUMBER)}"
    else:
        low, high = (10, 1_000_000) if field == "land_area" else (1, 100_000)
        good = f"coalesce(try_cast(regexp_extract({v}, {S.q(r'^([0-9]+(?:\.[0-9]+)?)㎡\z')}, 1) AS DOUBLE) BETWEEN {low} AND {high}, false)"
    return f"({v} <> '' AND NOT {S.has(v, P.DANGEROUS)} AND {good})"


FIELDS = ("location", "lot_number", "land_area", "building_area", "owner")
_LIST_TEXT = "array_to_string({}, ' | ')"
# All readings of each certificate, extracted like documents of their own and scored.
READ = (
    f"{NOISY}, rd AS (SELECT doc_id * 8 + arrival_no AS doc_id, raw_text AS text FROM reg_noisy){RECORD[len(DOCS):].replace('FROM reg_docs)', 'FROM rd)')}, "
    f"nt AS (SELECT doc_id * 8 + arrival_no AS doc_id, doc_id AS doc, source, arrival_no, raw_text AS text FROM reg_noisy), {S.quality('nt')}, "
    f"cd AS (SELECT q.*, {', '.join(f'rc.{n}' for n in FIELDS)}, rc.history FROM q JOIN rc USING (doc_id))"
)


def field_score(field: str) -> str:
    base = "label_count * 5 + japanese_ratio * 20 - noise_ratio * 10 + CASE WHEN source = 'ocr-normalized' THEN 8 ELSE 0 END"
    if field == "lot_number":
        base += f" + CASE WHEN {S.has(field, P.CONFIRMED_NUMBER)} THEN 40 ELSE 0 END"
    elif field in ("land_area", "building_area"):
        base += f" + CASE WHEN {S.has(field, P.CONFIRMED_AREA)} THEN 35 ELSE 0 END"
    elif field == "owner":
        base += f" + CASE WHEN {S.has(field, '株式会社|有限会社|合同会社|[一-龠]{2,}')} THEN 35 ELSE -30 END"
    else:
        base += f" + CASE WHEN {S.has(field, '[都道府県市区町村]')} THEN 35 ELSE -20 END"
    return f"CASE WHEN {field} <> '' THEN {base} END"


_MG = (
    "mg AS (SELECT doc, "
    + ", ".join(f"coalesce(max_by({n}, ({field_score(n)}, -arrival_no)) FILTER (WHERE {confirmed(n, n)}), '') AS {n}" for n in FIELDS)
    + f", coalesce(max_by(history, (len(history) * 12 + label_count * 2, -arrival_no)) FILTER (WHERE len(history) > 0), {NONE}) AS history FROM cd GROUP BY doc)"
)
MERGED = f"{READ}, {_MG}"


def label(source: str) -> str:
    return f"CASE {source} " + " ".join(f"WHEN '{s}' THEN '{t}'" for s, t in P.SOURCES) + " END"


_SOME = " OR ".join(f"mg.{n} <> ''" for n in FIELDS) + " OR len(mg.history) > 0"


def _provenance() -> str:
    return (
        f"mv AS ({' UNION ALL '.join(f'SELECT doc, {chr(39)}{n}{chr(39)} AS field, {n} AS v FROM mg' for n in FIELDS)}), cv AS ({' UNION ALL '.join(f'SELECT doc, source, arrival_no, {chr(39)}{n}{chr(39)} AS field, {n} AS v FROM cd' for n in FIELDS)}), "
        f"pr AS (SELECT doc AS doc_id, field, {label('min_by(source, arrival_no)')} AS source_label FROM mv JOIN cv USING (doc, field, v) WHERE v <> '' GROUP BY doc, field)"
    )


def workload(columns: str) -> str:
    """The whole election over all readings: candidates, gate, extraction of normalised texts, merge, provenance, decision and reasons."""
    gate = f"c0 AS (SELECT q.*, {', '.join(f'rc.{n}' for n in FIELDS)}, rc.history, max_by({S.STRONG}, (score, -arrival_no)) FILTER (WHERE NOT starts_with(source, 'ocr-')) OVER (PARTITION BY doc) AS strong FROM q JOIN rc USING (doc_id))"
    lines = []
    for name, shown, ground, none in REASONS:
        source = f"(SELECT source_label FROM pr WHERE pr.doc_id = de.doc_id AND pr.field = '{name}')"
        lines.append(f"'{shown}: ' || CASE WHEN {name} <> '' THEN {name} || '（{ground}' || coalesce(' / 採用元: ' || {source}, '') || '）' ELSE '{none}' END")
    reasons = " || ' | ' || ".join([*lines, "'history: ' || len(items) || '件（甲区所有権事項を優先）'"])
    return f"""{NOISY}, x AS MATERIALIZED (SELECT *, {S.normal_ocr('raw_text')} AS clean FROM reg_noisy),
cr AS MATERIALIZED (SELECT doc_id, source, arrival_no, CASE WHEN source = 'server' THEN clean ELSE raw_text END AS raw, CASE WHEN starts_with(source, 'ocr-') THEN clean ELSE raw_text END AS text FROM x),
rd AS MATERIALIZED (SELECT doc_id * 8 + arrival_no AS doc_id, {S.normal('raw')} AS text FROM cr){RECORD[len(DOCS):].replace('FROM reg_docs)', 'FROM rd)')},
nt AS (SELECT doc_id * 8 + arrival_no AS doc_id, doc_id AS doc, source, arrival_no, raw, text FROM cr), {S.quality('nt')},
{gate},
cd AS MATERIALIZED (SELECT * FROM c0 WHERE NOT starts_with(source, 'ocr-') OR (NOT coalesce(strong, false) AND length >= 20)),
{_MG}, {_provenance()},
be AS (SELECT doc, raw AS best, {S.USABLE} AS usable FROM cd QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, arrival_no) = 1),
pv AS (SELECT doc, raw AS preview FROM cd WHERE {S.PREVIEWABLE} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY {S.PREVIEW} DESC, arrival_no) = 1),
de AS (SELECT be.doc AS doc_id, {', '.join(f"CASE WHEN usable OR {_SOME} THEN mg.{n} ELSE '' END AS {n}" for n in FIELDS)}, CASE WHEN usable OR {_SOME} THEN mg.history ELSE {NONE} END AS items,
    CASE WHEN usable THEN best ELSE coalesce(preview, '') END AS raw, usable AS accepted, NOT usable AS warning FROM be JOIN mg USING (doc) LEFT JOIN pv USING (doc)),
re AS (SELECT *, {_LIST_TEXT.format('items')} AS history, {reasons} AS reasons FROM de)
SELECT {columns} FROM re"""


def _corrections(texts: str, keys: str) -> str:
    return f"{texts}, {S.counted('txt', keys, P.NUMBER_LABEL, P.PLACE_LABEL)}"


def _totals(texts: str, keys: str) -> str:
    return f"{_corrections(texts, keys)} SELECT label, CAST(sum(n) AS BIGINT) AS corrections, count(DISTINCT doc_id) AS documents FROM cor GROUP BY label ORDER BY corrections DESC, label LIMIT 12"


RECORD_COLUMNS = f"doc_id, {', '.join(FIELDS)}, history, raw, accepted, warning, reasons"


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["w2_readings_to_record"] = o["m1_stream_elect"] = workload(RECORD_COLUMNS)
    o["i2_field_reasons"] = workload("doc_id, reasons")
    noisy = f"{NOISY}, txt AS (SELECT doc_id, source, raw_text AS text FROM reg_noisy)"
    both = f"{NOISY}, txt AS (SELECT 'd' || doc_id AS doc_id, text FROM documents UNION ALL SELECT 'r' || doc_id, raw_text FROM reg_noisy)"
    o["l1_correction_totals"] = _totals(noisy, "doc_id, source")
    o["w3_corpus_report"] = _totals(both, "doc_id")
    o["m1_stream_corrections"] = f"SELECT label, corrections FROM ({o['l1_correction_totals']})"
    listed = "coalesce(array_to_string(list(label || '=' || n ORDER BY label), ', '), '')"
    o["b16_normalize_with_report"] = f"{_corrections(noisy, 'doc_id, source')} SELECT rep.doc_id, rep.source, any_value(rep.text) AS text, {listed.replace('ORDER BY label)', 'ORDER BY label) FILTER (WHERE label IS NOT NULL)')} AS corrections FROM rep LEFT JOIN cor USING (doc_id, source) GROUP BY rep.doc_id, rep.source"
    o["b13_correction_report"] = f"{_corrections(noisy, 'doc_id, source')} SELECT doc_id, source, CAST(rank AS INTEGER) AS rank, label, CAST(n AS INTEGER) AS count FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source ORDER BY n DESC, label) AS rank FROM cor) WHERE rank <= 12"
    o["a01_read_pages"] = f"{PAGES} SELECT doc_id, page_no, source, page_text FROM reg_pages"
    o["a02_assemble_documents"] = o["m1_stream_assemble"] = f"{PAGES} SELECT doc_id, source, {S.trim('string_agg(page_text, chr(10) ORDER BY page_no)')} AS text FROM reg_pages GROUP BY doc_id, source"
    o["a03_enough_text"] = f"SELECT doc_id, length({S.compact('coalesce(text, chr(32))')}) >= 20 AS enough FROM documents"
    enough = f"length({S.compact('coalesce(text, chr(32))')}) >= 20"
    o["a04_split_rejects"] = (
        f"WITH {X.SUBMISSIONS_SQL} SELECT doc_id, CASE WHEN contains(content_type, 'application/json') THEN CASE WHEN NOT {enough} THEN '{E.TOO_LITTLE_JSON}' END "
        f"WHEN contains(content_type, 'multipart/form-data') THEN CASE WHEN text IS NULL THEN '{E.NO_FILE}' WHEN NOT {enough} THEN '{E.TOO_LITTLE_FILE}' END ELSE '{E.BAD_TYPE}' END AS reason FROM submissions"
    )
    o["a05_parse_submissions"] = (
        f"WITH {X.SUBMISSIONS_SQL} SELECT doc_id, coalesce(body->>'$.rawText', '') AS raw_text, coalesce(body->>'$.format', '') AS format, coalesce(body->>'$.fields.location', '') AS location, "
        "coalesce(body->>'$.fields.owner', '') AS owner, CASE WHEN json_type(body, '$.fields.ownersHistory') = 'ARRAY' THEN array_to_string(list_filter(CAST(json_extract(body, '$.fields.ownersHistory') AS VARCHAR[]), lambda u: u <> ''), ' | ') ELSE '' END AS history FROM submissions"
    )
    o["a06_normalize_fields"] = f"{NORMAL} SELECT doc_id, location, number, area, \"buildingArea\", owner, {_LIST_TEXT.format('hist')} AS history FROM rn"
    o["a07_display_value"] = f"{NORMAL} SELECT doc_id, {_display('location')} AS location, {_display(chr(34) + 'buildingArea' + chr(34))} AS building_area FROM rn"
    o["a08_csv_report"] = f"{NORMAL} {_report([*_ROWS, (f'{chr(39)}{E.HISTORY_ROW}{chr(39)}', _HISTORY_CELL)])}"
    csv = " || chr(10) || ".join(f"{_quoted(i)} || ',' || {_quoted('(' + v + ')')}" for i, v in [*_ROWS, (f"'{E.HISTORY_ROW}'", _HISTORY_CELL)])
    o["a08_csv_text"] = f"{NORMAL} SELECT doc_id, chr(65279) || {csv} AS csv_text FROM rn"
    o["a09_workbook_summary"] = f"{NORMAL} {_report(_ROWS)}"
    o["a09_workbook_history"] = f"{NORMAL}, hl AS (SELECT doc_id, list_concat(['{E.HISTORY_ROW}'], CASE WHEN len(hist) > 0 THEN hist ELSE ['{P.NOT_DETECTED}'] END) AS l FROM rn) SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS row_no, unnest(l) AS value FROM hl"
    o["a10_export_columns"] = f"{NORMAL} SELECT doc_id, location, number, area, \"buildingArea\", owner, {_LIST_TEXT.format('hist')} AS history FROM rn"

    o["b01_fold_chars"] = f"SELECT doc_id, {S.fold('text')} AS text FROM documents"
    o["b02_join_digit_separators"] = f"SELECT doc_id, {S.separators('text')} AS text FROM documents"
    o["b03_collapse_ws"] = f"SELECT doc_id, {S.collapse('text')} AS text FROM documents"
    numbers = S.by_line("raw_text", S.repair_line)
    o["b04_repair_numbers"] = f"{NOISY}, x AS (SELECT doc_id, source, raw_text, {numbers} AS text FROM reg_noisy) SELECT doc_id, source, text, CAST(len(list_filter(list_zip(string_split(raw_text, chr(10)), string_split(text, chr(10))), lambda u: u[1] <> u[2])) AS INTEGER) AS changed_lines FROM x"
    o["b08_normalize_text"] = f"{NOISY} SELECT doc_id, source, {S.normal('raw_text')} AS text FROM reg_noisy"
    o["b05_repair_places"] = f"{NOISY}, x AS (SELECT doc_id, source, replace(raw_text, '郡山市', '都山市') AS t FROM reg_noisy), y AS (SELECT *, {S.sub('t', f'(所在{P.WS}*)都山市', r'\1郡山市')} AS u FROM x) SELECT doc_id, source, u AS text, t <> u AS changed FROM y"
    o["b06_apply_vocabulary"] = f"{NOISY} SELECT doc_id, source, {S.vocabulary('raw_text')} AS text FROM reg_noisy"
    o["b06_vocabulary_count"] = f"{NOISY} SELECT doc_id, source, {S.n_of('raw_text', P.spaced(P.VOCABULARY[10][0]))} AS causes, {S.n_of('raw_text', P.spaced(P.VOCABULARY[4][0]))} AS rights, concat_ws(',', {', '.join(S.n_of('raw_text', P.spaced(v)) for v, _, _ in P.VOCABULARY)}) AS counts FROM reg_noisy"
    despaced = f"array_to_string(list_transform(string_split(raw_text, chr(10)), lambda u: {S.despace('u')}), chr(10))"
    o["b07_despace_lines"] = f"{NOISY} SELECT doc_id, source, {despaced} AS text FROM reg_noisy"
    o["b09_normalize_labels"] = f"{NOISY} SELECT doc_id, source, {S.labels('raw_text')} AS text FROM reg_noisy"
    o["b10_clean_value"] = f"SELECT doc_id, {S.clean('text')} AS text FROM documents"
    o["b11_lines_of"] = f"{LONG} SELECT doc_id, line_no, line FROM lo"
    o["b12_unique_clean"] = f"{DOCS} SELECT doc_id, array_to_string({S.unique_clean('string_split(text, chr(10))')}, ' | ') AS items FROM reg_docs"
    o["b14_normalization_summary"] = (
        f"WITH bt AS (SELECT doc_id, text FROM documents), {S.quality('bt', 'q')}, ft AS (SELECT doc_id, {S.fold('text')} AS text FROM documents), {S.quality('ft', 'r')} "
        f"SELECT q.doc_id, '正規化前スコア: ' || {ROUND.format('q.score')} || ' / 後: ' || {ROUND.format('r.score')} || ' | ラベル数: ' || q.label_count || ' → ' || r.label_count || "
        f"' | 日本語率: ' || {ROUND.format('q.japanese_ratio * 100')} || '% → ' || {ROUND.format('r.japanese_ratio * 100')} || '% | ノイズ率: ' || {ROUND.format('q.noise_ratio * 100')} || '% → ' || {ROUND.format('r.noise_ratio * 100')} || '%' AS summary FROM q JOIN r USING (doc_id)"
    )
    o["b15_clip_text"] = "SELECT doc_id, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || chr(10) || '...（以下省略）' ELSE text END AS text FROM documents"

    o["c01_is_noise_line"] = f"WITH u0 AS (SELECT doc_id, unnest(string_split(replace(text, '.', chr(10)), chr(10))) AS l FROM documents), u AS (SELECT doc_id, {S.clean('l')} AS l FROM u0) SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE {S.noise_cleaned('l')} OR len(list_filter(range(1, greatest(length(l) - 5, 1)), lambda i: substr(l, i, 7) = repeat(substr(l, i, 1), 7) AND length(l) >= 7)) > 0) AS noise FROM u GROUP BY doc_id"
    o["c02_looks_like_garbage"] = f"SELECT doc_id, {S.garbage('text')} AS flag FROM documents"
    o["c03_is_plausible"] = _flag(S.plausible("line"))
    o["c04_has_contamination"] = _flag(S.has("line", P.CONTAMINATION))
    o["c05_noise_ratios"] = f"SELECT doc_id, {S.ascii_noise('text', 0.25)} AS ascii_noise, {S.symbol_noise('text', 0.12)} AS symbol_noise FROM documents"
    o["c06_has_noise_token"] = f"SELECT doc_id, {S.has('text', P.NOISE_TOKENS)} AS flag FROM documents"
    o["c07_header_or_excluded"] = f"{DOCS}, l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM reg_docs) SELECT doc_id, line, {S.has('line', P.HEADER)} AS header, {S.has('line', P.EXCLUDED_RIGHTS)} AS excluded FROM l"
    o["c08_looks_like"] = f"{LONG} SELECT doc_id, line_no, {S.corp('line')} AS corp, {S.person('line')} AS person, {S.has('line', P.ADDRESS)} AS address FROM lo"
    value = "regexp_replace(line, '^[^ ]+ ', '')"
    o["c09_safe_location"] = f"{LONG} SELECT doc_id, line_no, {S.safe_location(value)} AS value FROM lo"
    o["c10_safe_number"] = f"{LONG} SELECT doc_id, line_no, {S.safe_number(value)} AS value FROM lo"
    o["c11_areas"] = f"{LONG} SELECT doc_id, line_no, {S.normalize_area(value)} AS normalized, {S.safe_area(value)} AS safe FROM lo"
    o["c12_safe_owner"] = f"{LONG} SELECT doc_id, line_no, {S.safe_owner(value)} AS value FROM lo"
    o["c13_is_history_noise"] = _flag(S.history_noise("line"))
    o["c14_count_history_noise"] = f"{NOISY} SELECT doc_id, source, len(list_filter(string_split_regex(raw_text, '\\n+'), lambda u: {S.has(S.trim('u'), P.LIKELY_HISTORY_NOISE)})) AS n FROM reg_noisy"

    o["d01_first_line_index"] = f"{LINES} SELECT doc_id, {S.first_index('ls', '甲区')} AS kouku, {S.first_index('ls', '乙区', 'len(ls)')} AS otsuku FROM ll"
    o["d02_cut_excluded"] = f"{LINES} SELECT doc_id, {_LIST_TEXT.format(S.cut_at('ls', P.EXCLUDED_RIGHTS))} AS lines FROM ll"
    one = lambda n: f"SELECT doc_id, '{n}' AS section, CAST(unnest(range(0, len({n}))) AS INTEGER) AS line_no, unnest({n}) AS line FROM ss"
    o["d03_split_sections"] = f"{SECTIONS} " + " UNION ALL ".join(map(one, ("title", "rights", "kouku", "otsuku", "collateral")))

    o["e01_value_after_label"] = f"{LONG} SELECT doc_id, line_no, {S.value_after_label('line', '地番')} AS number, {S.value_after_label('line', '地積')} AS area FROM lo"
    o["e02_label_value"] = f"{SECTIONS} SELECT doc_id, {S.label_value('title', '所在', 6)} AS location, {S.label_value('title', '地番', 5)} AS number FROM ss"
    o["e03_inline_row_value"] = f"{SECTIONS} SELECT doc_id, {S.inline_row('title', '所在')} AS location, {S.inline_row('title', '地番')} AS number FROM ss"
    o["e04_area_by_label"] = f"{SECTIONS} SELECT doc_id, {S.area_by_label('title', '地積', 5)} AS title_area, {S.area_by_label('ls', '床面積', 2)} AS floor_area FROM ss"
    o["e05_extract_location"] = f"{TITLE} SELECT doc_id, location FROM tf"
    o["e06_extract_lot_number"] = f"{TITLE} SELECT doc_id, lot_number FROM tf"
    o["e07_extract_areas"] = f"{TITLE} SELECT doc_id, land_area, building_area FROM tf"

    o["f01_is_entry_start"] = f"{LONG} SELECT doc_id, line_no, {START} AS flag FROM lo"
    o["f02_segment_entries"] = f"{BLOCKS} SELECT doc_id, CAST(block - 1 AS INTEGER) AS block_no, array_to_string(list(line ORDER BY i), ' | ') AS lines FROM kn GROUP BY doc_id, block"
    o["f03_merge_receipt_blocks"] = f"{ENTRIES} SELECT doc_id, entry_no AS block_no, {_LIST_TEXT.format('lines')} AS lines FROM e0"
    entry = lambda *cols: f"{PARSED} SELECT doc_id, entry_no, {', '.join(cols)} FROM en"
    o["f04_entry_cause"] = entry("cause")
    o["f05_entry_receipt"] = entry("receipt")
    o["f06_entry_purpose"] = entry("purpose")
    o["f07_owner_candidates"] = entry(_LIST_TEXT.format("owners") + " AS owners")
    o["f08_event_type"] = entry("event_type")
    o["f09_invalid_or_ownership"] = entry("invalid", "ownership_event")
    o["f10_has_shared_marker"] = entry("shared")
    o["f11_share_fraction"] = entry("share")
    o["f12_share_and_person_candidates"] = entry("CAST(0 AS INTEGER) AS shares", _LIST_TEXT.format("persons") + " AS persons")
    o["f13_parse_entries"] = entry(_LIST_TEXT.format("lines") + " AS lines", "purpose", "receipt", "cause", _LIST_TEXT.format("owners") + " AS owners", "event_type", "invalid", "ownership_event")

    o["g1_replay_ownership"] = f"{REPLAY} SELECT ss.doc_id, coalesce(owner, '') AS owner FROM ss LEFT JOIN state USING (doc_id)"
    o["g1_replay_rows"] = f"{REPLAY} SELECT doc_id, owner FROM state"
    note = (
        f"CASE kind WHEN 'M' THEN 'Full event contains multiple owners/share text; kept readable owner list: ' || array_to_string(own, ' / ') WHEN 'R' THEN 'Full ownership event replaced owners: ' || array_to_string(own, ' / ') "
        f"WHEN 'S' THEN 'Partial/share event retained: ' || CASE WHEN summary <> '' THEN summary ELSE event_type END END"
    )
    told = f"""d0 AS (SELECT doc_id, entry_no, {SUMMARY} AS summary, kind, own, event_type FROM v1), d1 AS (SELECT *, {note} AS note FROM d0),
d2 AS (SELECT doc_id, count(*) AS n, coalesce(list(note ORDER BY entry_no) FILTER (WHERE note IS NOT NULL), {NONE}) AS notes, coalesce(max_by(summary, entry_no) FILTER (WHERE summary <> ''), '') AS latest FROM d1 GROUP BY doc_id),
d3 AS (SELECT ss.doc_id, list_concat(list_concat(['Kouku event count: ' || coalesce(n, 0)], coalesce(notes, {NONE})), list_filter([CASE WHEN after THEN 'Later partial/share transfer exists; Earnest One was not adopted as sole latest owner.' END,
    CASE WHEN coalesce(latest, '') <> '' THEN 'Latest event used for owner judgment: ' || latest END, 'Assembled ownership state: ' || CASE WHEN coalesce(owner, '') <> '' THEN owner ELSE 'unconfirmed' END], lambda u: u IS NOT NULL)) AS l FROM ss LEFT JOIN d2 USING (doc_id) LEFT JOIN state USING (doc_id))"""
    o["g2_ownership_diagnostics"] = f"{REPLAY}, {told} SELECT doc_id, array_to_string({S.unique_clean('l')}, ' | ') AS diagnostics FROM d3"
    o["g3_latest_owners"] = f"{PARSED}, lv AS (SELECT doc_id, max_by(owners, entry_no) AS owners FROM en WHERE ownership_event AND NOT invalid GROUP BY doc_id) SELECT ss.doc_id, array_to_string(coalesce(owners, {NONE}), ' | ') AS owners FROM ss LEFT JOIN lv USING (doc_id)"
    o["g4_owner_history"] = f"{HIST} SELECT doc_id, {_LIST_TEXT.format('history')} AS history FROM fall"
    o["g5_fallback_owners"] = f"{HIST} SELECT doc_id, {_LIST_TEXT.format('fallback')} AS owners FROM fall"
    o["g6_extract_fields"] = f"{RECORD} SELECT doc_id, location, lot_number, land_area, building_area, owner, {_LIST_TEXT.format('history')} AS history FROM rc"
    nd = lambda c: f"CASE WHEN {c} <> '' THEN {c} ELSE 'not detected' END"
    got = lambda c, how, none: f"CASE WHEN {c} <> '' THEN '{how}' || {c} ELSE '{none}' END"
    fields_told = (
        f"'Title section: not found | Title lines inspected: ' || len(title) || ' | Location: ' || {got('location', 'accepted from title section: ', 'not detected; rejected owner-address/collateral/noisy candidates')}"
        f" || ' | Number: ' || {got('lot_number', 'accepted near title land-number label: ', 'not detected; map-number/address-number/collateral candidates rejected')}"
        f" || ' | Land area: ' || {got('land_area', 'accepted near title land-area label: ', 'not detected; unlabeled small area/debt amount candidates rejected')} || ' | Building title: not found | Building area: ' || "
        f"{got('building_area', 'accepted near floor-area/building-area label: ', 'not detected or building title not present')} || ' | Otsuku exclusion: ' || CASE WHEN len(otsuku) > 0 THEN 'found and excluded' ELSE 'none' END"
        f" || ' | Collateral exclusion: ' || CASE WHEN len(collateral) > 0 THEN 'found and excluded' ELSE 'none' END || ' | Export values: owner=' || {nd('owner')} || ' / location=' || {nd('location')} || ' / number=' || {nd('lot_number')} || ' / area=' || {nd('land_area')} || ' / buildingArea=' || {nd('building_area')}"
    )
    o["g7_field_diagnostics"] = f"{RECORD} SELECT doc_id, {fields_told} AS diagnostics FROM rc"
    yes = lambda p, no: f"CASE WHEN {S.has('c', p)} THEN 'あり' ELSE '{no}' END"
    blank = lambda c: f"CASE WHEN {c} <> '' THEN {c} ELSE '空欄' END"
    noise = f"len(list_filter(string_split_regex(text, '\\n+'), lambda u: {S.has(S.trim('u'), P.LIKELY_HISTORY_NOISE)}))"
    o["i1_structure_summary"] = (
        f"{RECORD}, {told}, s0 AS (SELECT rc.*, reg_docs.text, {S.compact('reg_docs.text')} AS c, {S.unique_clean('d3.l')} AS told FROM rc JOIN reg_docs USING (doc_id) JOIN d3 USING (doc_id)) "
        f"SELECT doc_id, '表題部候補: ' || {yes(P.TITLE_START, '未確認')} || ' | 甲区候補: ' || {yes('甲区|所有権移転|所有権一部移転|持分一部移転', '未確認')} || ' | 乙区除外候補: ' || {yes('乙区|抵当権', 'なし')}"
        f" || ' | 共同担保除外候補: ' || {yes('共同担保|担保目録', 'なし')} || ' | ownersHistory有効件数: ' || len(history) || '件 | 甲区所有関係診断: ' || len(told) || '件 | ' || array_to_string(told, ' | ')"
        f" || ' | Title/field diagnostics: 10 items | ' || {fields_told} || ' | ownersHistoryノイズ除外目安: ' || {noise} || '行 | 最新所有者: ' || CASE WHEN owner <> '' THEN '確定候補あり' ELSE '未検出（最新有効エントリの人名/法人名根拠不足）' END"
        f" || ' | CSV/Excel確定値: owner=' || {blank('owner')} || ' / location=' || {blank('location')} || ' / number=' || {blank('lot_number')} || ' / area=' || {blank('land_area')} || ' / buildingArea=' || {blank('building_area')} AS summary FROM s0"
    )

    o["h1_text_quality"] = f"{READINGS} SELECT doc_id, source, round(score, 6) AS score, CAST(label_count AS BIGINT) AS label_count, round(japanese_ratio, 6) AS japanese_ratio, round(noise_ratio, 6) AS noise_ratio, CAST(garbage_lines AS BIGINT) AS garbage_lines, length, CAST(line_count AS BIGINT) AS line_count FROM q"
    o["h1_text_quality_real"] = f"WITH rt AS (SELECT doc_id, text FROM documents), {S.quality('rt')} SELECT doc_id, round(score, 6) AS score, CAST(garbage_lines AS BIGINT) AS garbage_lines, length FROM q"
    o["h2_is_usable"] = f"{READINGS} SELECT doc_id, source, {S.USABLE} AS usable FROM q"
    o["h3_previewable_strong"] = f"{READINGS} SELECT doc_id, source, {S.PREVIEWABLE} AS previewable, {S.STRONG} AS strong FROM q"
    o["h4_preview_score"] = f"{READINGS} SELECT doc_id, source, round({S.PREVIEW}, 6) AS preview_score FROM q"
    o["h5_route_pages"] = _route()
    o["h6_best_variant_per_page"] = f"{_BEST} SELECT doc_id, page_no, source FROM win"
    o["h7_adopted_source"] = f"{_ADOPTED}, asm AS (SELECT doc_id, {_assembled('page_no')} AS text FROM win GROUP BY doc_id) SELECT doc_id, source, text FROM top JOIN asm USING (doc_id)"
    gated = f"{READINGS}, g0 AS (SELECT *, max_by({S.STRONG}, (score, -arrival_no)) FILTER (WHERE NOT starts_with(source, 'ocr-')) OVER (PARTITION BY doc_id) AS strong FROM q)"
    o["h8_candidate_set"] = f"{NOISY}, x AS (SELECT *, {S.normal_ocr('raw_text')} AS clean FROM reg_noisy) SELECT doc_id, source, arrival_no, CASE WHEN source = 'server' THEN clean ELSE raw_text END AS raw_text, CASE WHEN starts_with(source, 'ocr-') THEN clean ELSE raw_text END AS scored_text FROM x"
    o["h9_gate_ocr"] = f"{gated} SELECT doc_id, source FROM g0 WHERE NOT starts_with(source, 'ocr-') OR (NOT coalesce(strong, false) AND length >= 20)"
    o["h10_best_candidate"] = f"{READINGS} SELECT doc_id, source FROM q QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, arrival_no) = 1"
    o["h10_preview_candidate"] = f"{READINGS} SELECT doc_id, source FROM q WHERE {S.PREVIEWABLE} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY {S.PREVIEW} DESC, arrival_no) = 1"
    o["h11_field_score"] = f"{READ} SELECT doc AS doc_id, source, {', '.join(f'round({field_score(n)}, 6) AS {n}' for n in FIELDS)} FROM cd"
    o["h13_merge_fields"] = f"{MERGED} SELECT doc AS doc_id, {', '.join(FIELDS)}, {_LIST_TEXT.format('history')} AS history FROM mg"
    o["h14_field_provenance"] = f"{MERGED}, {_provenance()} SELECT * FROM pr"
    some = _SOME
    o["h16_decide"] = f"""{MERGED}, be AS (SELECT doc, text, {S.USABLE} AS usable FROM cd QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, arrival_no) = 1),
pv AS (SELECT doc, text AS preview FROM cd WHERE {S.PREVIEWABLE} QUALIFY row_number() OVER (PARTITION BY doc ORDER BY {S.PREVIEW} DESC, arrival_no) = 1)
SELECT be.doc AS doc_id, CASE WHEN usable OR {some} THEN mg.owner ELSE '' END AS owner, CASE WHEN usable OR {some} THEN mg.location ELSE '' END AS location,
    CASE WHEN usable THEN be.text ELSE coalesce(preview, '') END AS raw, usable AS accepted, NOT usable AS warning FROM be JOIN mg USING (doc) LEFT JOIN pv USING (doc)"""
    o["h12_is_confirmed"] = f"{RECORD} SELECT doc_id, {', '.join(f'{confirmed(n, n)} AS {n}' for n in FIELDS)} FROM rc"
    o["h15_completeness"] = f"{RECORD} SELECT doc_id, {' + '.join(f'CAST({n} <> {chr(39)}{chr(39)} AS INTEGER)' for n in FIELDS)} + CAST(len(history) > 0 AS INTEGER) AS completeness FROM rc"

    o["i3_extracted_summary"] = f"{RECORD} SELECT doc_id, 'location: ' || CASE WHEN location <> '' THEN location ELSE '{P.NOT_DETECTED}' END || ' / number: ' || CASE WHEN lot_number <> '' THEN lot_number ELSE '{P.NOT_DETECTED}' END || ' / owner: ' || CASE WHEN owner <> '' THEN owner ELSE '{P.NOT_DETECTED}' END || ' / history: ' || len(history) || '件' AS summary FROM rc"
    o["i3_read_meta"] = f"{READINGS} SELECT doc_id, source, '読み取り方法: ' || {label('source')} || ' / 品質スコア: ' || {ROUND.format('score')} AS meta FROM q"

    o["j1_apply_templates"] = " UNION ALL ".join(f"SELECT c_custkey AS doc_id, '{n}' AS template, {_fill(s)} AS subject, {_fill(b)} AS body FROM (SELECT *, c_mktsegment AS c_address FROM customer)" for n, _, s, b in TEMPLATES)
    o["k1_tone_map"] = f"WITH {X.PIXELS_SQL} SELECT image_id, y, x, {_grey(*TONES['light'])} AS grey FROM pixels"
    o["k2_otsu_threshold"] = f"{OTSU} SELECT image_id, threshold FROM th"
    o["k3_binarize_despeckle"] = (
        f"{BINARY}, nb AS (SELECT a.image_id, a.y, a.x, count(*) AS near FROM bw a JOIN bw b ON a.image_id = b.image_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND NOT (a.y = b.y AND a.x = b.x) WHERE b.value = 0 GROUP BY ALL) "
        "SELECT image_id, y, x, CAST(CASE WHEN value = 0 AND y BETWEEN 1 AND 6 AND x BETWEEN 1 AND 6 AND coalesce(near, 0) <= 1 THEN 255 ELSE value END AS INTEGER) AS value FROM bw LEFT JOIN nb USING (image_id, y, x)"
    )
    o["k4_auto_crop"] = (
        f"{GREY}, bx AS (SELECT image_id, min(y) FILTER (WHERE grey < 245) AS y0, max(y) FILTER (WHERE grey < 245) AS y1, min(x) FILTER (WHERE grey < 245) AS x0, max(x) FILTER (WHERE grey < 245) AS x1 FROM gp GROUP BY image_id), "
        "ed AS (SELECT image_id, greatest(0, least(7, coalesce(y0, 8)) - 1) AS t, least(7, coalesce(y1, 7) + 1) AS b, greatest(0, least(7, coalesce(x0, 8)) - 1) AS l, least(7, coalesce(x1, 7) + 1) AS r FROM bx), "
        "ok AS (SELECT *, r - l + 1 >= 6 AND b - t + 1 >= 6 AS wide FROM ed) SELECT image_id, CAST(CASE WHEN wide THEN t ELSE 0 END AS INTEGER) AS top, CAST(CASE WHEN wide THEN b ELSE 7 END AS INTEGER) AS bottom, CAST(CASE WHEN wide THEN l ELSE 0 END AS INTEGER) AS \"left\", CAST(CASE WHEN wide THEN r ELSE 7 END AS INTEGER) AS \"right\", wide AS cropped FROM ok"
    )
    o["l2_fill_rates"] = f"{RECORD}, fr AS (" + " UNION ALL ".join(f"SELECT '{n}' AS field, {n} AS v FROM rc" for n in FIELDS) + ") SELECT field, count(*) FILTER (WHERE v <> '') AS detected, count(*) FILTER (WHERE v = '') AS missing FROM fr GROUP BY field"
    filled = " + ".join(f"CAST({n} <> '' AS INTEGER)" for n in FIELDS) + " + CAST(len(history) > 0 AS INTEGER)"
    o["l2_completeness_counts"] = f"{RECORD} SELECT {filled} AS completeness, count(*) AS documents FROM rc GROUP BY ALL"
    o["w1_text_to_record"] = f"{NORMAL_RECORD} SELECT doc_id, {', '.join(FIELDS)}, {_LIST_TEXT.format('history')} AS history FROM rc"
    o["m1_stream_extract"] = f"{NORMAL_RECORD} SELECT doc_id, owner, location, lot_number, land_area, building_area, {_LIST_TEXT.format('history')} AS history FROM rc JOIN reg_docs USING (doc_id) WHERE length({S.compact('reg_docs.text')}) >= 20"
    o["l3_source_and_tier_counts"] = f"{READINGS} SELECT source, CASE WHEN {S.STRONG} THEN 'strong' WHEN {S.USABLE} THEN 'usable' WHEN {S.PREVIEWABLE} THEN 'previewable' ELSE 'rejected' END AS tier, count(*) AS readings FROM q GROUP BY ALL"
    o["l4_event_counts"] = f"{PARSED} SELECT event_type, invalid, count(*) AS events FROM en GROUP BY ALL"
    for name in ("d03_split_sections", "e02_label_value", "f02_segment_entries", "f03_merge_receipt_blocks"):
        o[f"{name}_long"] = o[name]
    o["d01_first_line_long"] = o["d01_first_line_index"]
    o["k_clean_pages"] = o["k3_binarize_despeckle"]
    named = {"propertyName": "owner", "lotNumber": "number", "landArea": "area", "buildingArea": '"buildingArea"'}
    uses = [(n, lab, sorted({k for k in ("propertyName", "location", "lotNumber", "landArea", "buildingArea", "usage", "owner") if "{{" + k + "}}" in subject + body})) for n, lab, subject, body in TEMPLATES]
    has_all = lambda ks: " AND ".join(f"{S.trim(f'coalesce({named.get(k, k)}, {chr(39)}{chr(39)})')} <> ''" for k in ks if k != "usage")
    o["j2_template_catalogue"] = f"WITH {X.RECORDS_SQL} " + " UNION ALL ".join(f"SELECT '{n}' AS template, '{lab}' AS label, CAST({len(ks)} AS BIGINT) AS places, count(*) AS records, count(*) FILTER (WHERE {has_all(ks)}) AS complete FROM records" for n, lab, ks in uses)
    o["a01_read_texts"] = "SELECT doc_id, length(text) AS n_chars, sha256(text) AS sha256 FROM documents WHERE length(text) > 0"
    o["a08_export_documents"] = o["a08_csv_text"]
    split = o["a04_split_rejects"]
    o["a04_reject_reasons"] = f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '{E.BROKEN}' ELSE reason END AS reason FROM ({split}) WHERE doc_id % 9 = 0 OR reason IS NOT NULL"
    o["a04_observed_counts"] = f"SELECT coalesce(reason, 'accepted') AS outcome, count(*) AS n FROM ({split}) GROUP BY 1"
    o["n_column_functions"] = f"SELECT doc_id, {S.fold('text')} AS folded, {S.separators('text')} AS joined, {S.clean('text')} AS cleaned, CASE WHEN length(text) > 5000 THEN substr(text, 1, 5000) || chr(10) || '...（以下省略）' ELSE text END AS clipped, length({S.compact('text')}) >= 20 AS enough, {S.has('text', P.NOISE_TOKENS)} AS noise FROM documents"
    o["n_lines_of"] = o["b11_lines_of"]
    return o
