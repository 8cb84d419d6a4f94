"""Text normalisation as Column functions; the vocabulary chain with counts is one Arrow-batched helper."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache, reduce

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P

_FOLD_FROM = "\r\u3000０１２３４５６７８９㎡m²㎥｜|"
_FOLD_TO = "\n 0123456789㎡㎡㎡㎡  "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, also inside higher-order functions.

    As the start of an aggregate over nothing, for transform() copies what its function returns, arrays with all their texts.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda held, _: held, body)


def once(make: Callable) -> Callable:
    """make() called once a Spark context. A column of many parts takes thousands of calls to the JVM, which cost seconds;
    what is made of column names alone serves every plan of the session."""
    held: dict = {}

    def made():
        context = SparkContext._active_spark_context
        if held.get("context") is not context:
            held.update(context=context, made=make())
        return held["made"]

    return made


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(P.BLANKS))


def compact(text: Column) -> Column:
    return F.regexp_replace(text, P.WS, "")


def fold_chars(text: Column) -> Column:
    """Line ends, wide blanks and digits, square-metre signs (every Latin m with them) and bars, one for one."""
    return F.translate(text, _FOLD_FROM, _FOLD_TO)


def join_digit_separators(text: Column) -> Column:
    """= or : between digits becomes a hyphen."""
    return F.regexp_replace(text, f"([0-9]){P.WS}*[=:]{P.WS}*([0-9])", "$1-$2")


def collapse_ws(text: Column) -> Column:
    """No bracket after digits; two and more white spaces, line ends too, become one blank."""
    return F.regexp_replace(F.regexp_replace(text, r"([0-9]+)\)", "$1"), P.WS + "{2,}", " ")


def repair_line(line: Column) -> Column:
    """Digits misread as letters in a line that is about numbers."""
    tail = r"(?=[0-9号番\-]|\z)"
    out = F.regexp_replace(line, "[§ＳS](?=[0-9])", "5")
    for chars, digit in (("[§ＳS]", "5"), ("B", "8"), ("[Il|｜]", "1"), ("O", "0")):
        out = F.regexp_replace(out, f"(?<=[0-9]){chars}{tail}", digit)
    out = F.regexp_replace(out, f"第{P.WS}*([0-9]+){P.WS}+([0-9]+){P.WS}*号", "第$1$2号")
    out = join_digit_separators(out)
    out = F.regexp_replace(out, f"([0-9]){P.WS}+([0-9]){P.WS}*分{P.WS}*の{P.WS}*([0-9])", "$1$2分の$3")
    out = F.regexp_replace(out, f"([0-9]+){P.WS}*分{P.WS}*の{P.WS}*([0-9]+)", "$1分の$2")
    return F.when(line.rlike(P.NUMBER_CONTEXT), out).otherwise(line)


def repair_numbers(text: Column) -> Column:
    """struct(text, changed_lines)."""
    lines = F.split(text, "\n", -1)
    return let(
        F.transform(lines, lambda x: F.struct(x.alias("a"), repair_line(x).alias("b"))),
        lambda ls: F.struct(F.array_join(ls["b"], "\n").alias("text"), F.size(F.filter(ls, lambda x: x["a"] != x["b"])).alias("changed_lines")),
    )


def place_text(text: Column) -> Column:
    return F.regexp_replace(text, f"(所在{P.WS}*)都山市", "$1郡山市")


def repair_places(text: Column) -> Column:
    """struct(text, changed): a misread city right after the location label."""
    return let(text, lambda a: let(place_text(a), lambda b: F.struct(b.alias("text"), (a != b).alias("changed"))))


def may_change(text: Column, variants: str, term: str) -> Column:
    """Whether a rule may change the text: a cheap test for a literal of each variant, and only then its pattern.

    A variant that is the term but for white space changes nothing where it stands without any.
    """
    tests = []
    for one in variants.split("|"):
        literal = max(reversed(re.split(r"\.\*\?|.\?|\\.|\[[^\]]*\]|_", one)), key=len)
        parts = one.split("_")
        if len(parts) > 1 and "".join(parts) == term:
            pattern = "|".join(f"{a}{P.WS}+{b}" for a, b in zip(parts, parts[1:]))
        else:
            pattern = P.spaced(one)
        tests.append(text.contains(literal) if literal == one else text.contains(literal) & text.rlike(pattern))
    return reduce(lambda a, b: a | b, tests)


RULES_AT_ONCE = 6


def apply_rules(text: Column, rules: Sequence[tuple]) -> Column:
    """Replacements in order; rules begin with (variants, term).

    A few rules at a time are left out together where none of them may change the text.
    """

    def part(some: Sequence[tuple]) -> Callable[[Column], Column]:
        def replaced(t: Column) -> Column:
            out = t
            for variants, term, *_ in some:
                out = F.regexp_replace(out, P.spaced(variants), term)
            return F.when(reduce(lambda a, b: a | b, [may_change(t, v, to) for v, to, *_ in some]), out).otherwise(t)

        return replaced

    boxed = F.array(text)  # in an array of one, the text is made once and named often
    for k in range(0, len(rules), RULES_AT_ONCE):
        boxed = F.transform(boxed, part(rules[k : k + RULES_AT_ONCE]))
    return F.get(boxed, F.lit(0))


def apply_vocabulary_text(text: Column, rules=P.VOCABULARY) -> Column:
    """The vocabulary's replacements in order, without counts: by one vectorised helper, with rules of one's own by built-in functions."""
    return apply_rules(text, rules) if rules is not P.VOCABULARY else F.pandas_udf(_vocabulary_batches, "string")(text)


def vocabulary_count(text: Column, variants: str) -> Column:
    return F.regexp_count(text, F.lit(P.spaced(variants))).cast("long")


def vocabulary_counts(text: Column) -> Column:
    """array<long>: vocabulary_count() of every rule, in order; null of null."""
    return F.pandas_udf(_vocabulary_count_batches, "array<long>")(text)


def despace_line(line: Column) -> Column:
    j = P.JOINED_CHARS
    for left, right in ((f"[{j}]", f"[{j}]"), (f"[{j}]", "[0-9]"), ("[0-9]", "[0-9]"), ("[0-9]", "[年月日番号]"), ("[年月日番号]", "[0-9]")):
        line = F.regexp_replace(line, f"({left}){P.WS}+(?={right})", "$1")
    return js_trim(F.regexp_replace(line, P.WS + "{2,}", " "))


def despace_lines(text: Column) -> Column:
    """White space between letters of one word or number taken out, line by line."""
    return F.array_join(F.transform(F.split(text, "\n", -1), despace_line), "\n")


def normalize_labels(text: Column, rules=P.LABEL_RULES) -> Column:
    return apply_rules(text, rules)


def cleaned(x: Column) -> Column:
    """clean_value() of a value that costs nothing to name often, as in SQL, which can't say let().

    Most values are clean: one look tells, and the steps are for the others.
    """
    out = F.translate(x, "|｜()（）【】「」『』‐‑‒–—―", " " * 12 + "-" * 6)
    out = F.regexp_replace(out, f"^[:：・\\-{P.WS_CHARS}]+", "")
    return F.when(x.rlike(P.CLEAN_JAVA), x).otherwise(js_trim(F.regexp_replace(out, P.WS + "{2,}", " ")))


def clean_value(text: Column) -> Column:
    """Bars and brackets as blanks, dashes as hyphens, no marks in front, single blanks, trimmed."""
    return let(text, cleaned)


def unique_clean(values: Column) -> Column:
    """Cleaned values without empty ones, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(values, clean_value), lambda x: x != ""))


def clip_text(text: Column, limit: int = 5000) -> Column:
    t = F.coalesce(text, F.lit(""))
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n...（以下省略）"))).otherwise(t)


def finish_text(text: Column) -> Column:
    return js_trim(F.regexp_replace(text, "\n{2,}", "\n"))


def front(text: Column) -> Column:
    """The steps before the vocabulary chain, text only."""
    return collapse_ws(join_digit_separators(fold_chars(text)))


def chain_text(text: Column, rules=P.VOCABULARY) -> Column:
    return apply_vocabulary_text(place_text(repair_numbers(text)["text"]), rules)


def normalize_ocr(text: Column, rules=P.VOCABULARY) -> Column:
    """The normalised text: by one vectorised helper, with rules of one's own by built-in functions."""
    if rules is not P.VOCABULARY:
        return finish_text(chain_text(despace_lines(chain_text(front(F.coalesce(text, F.lit(""))), rules)), rules))
    return F.pandas_udf(_ocr_batches, "string")(text)


def label_text(normalized: Column) -> Column:
    """Blanks and blank lines collapsed again, units folded, labels normalised."""
    out = F.regexp_replace(normalized, "[ \t]+", " ")
    out = js_trim(F.regexp_replace(F.translate(out, _FOLD_FROM[:-2], _FOLD_TO[:-2]), "\n{2,}", "\n"))
    return normalize_labels(out)


def normalize_text(text: Column) -> Column:
    """What extraction reads: label_text() of normalize_ocr(), in one pass."""
    return F.pandas_udf(_label_batches, "string")(text)


#: normalize_text() of the column `text`.
normal_of_text = once(lambda: normalize_text(F.coalesce(F.col("text"), F.lit(""))))


@lru_cache(maxsize=1)
def _compiled() -> tuple:
    py = P.python_pattern
    number = [(re.compile(py(a)), b) for a, b in (
        ("[§ＳS](?=[0-9])", "5"),
        *((f"(?<=[0-9]){c}(?=[0-9号番\\-]|\\z)", d) for c, d in (("[§ＳS]", "5"), ("B", "8"), ("[Il|｜]", "1"), ("O", "0"))),
        (f"第{P.WS}*([0-9]+){P.WS}+([0-9]+){P.WS}*号", r"第\1\2号"),
        (f"([0-9]){P.WS}*[=:]{P.WS}*([0-9])", r"\1-\2"),
        (f"([0-9]){P.WS}+([0-9]){P.WS}*分{P.WS}*の{P.WS}*([0-9])", r"\1\2分の\3"),
        (f"([0-9]+){P.WS}*分{P.WS}*の{P.WS}*([0-9]+)", r"\1分の\2"),
    )]
    return re.compile(P.NUMBER_CONTEXT), number, re.compile(py(f"(所在{P.WS}*)都山市")), [(re.compile(py(P.spaced(v))), t, n) for v, t, n in P.VOCABULARY]


def plain_variants(variants: str) -> list[str]:
    """The literal forms of a rule's variants without white space: sets of letters written out, letters that may lack left out."""
    out = []
    for one in variants.split("|"):
        forms = [""]
        for token in re.findall(r"\[[^\]]*\]|.\??", one.replace("_", "")):
            choices = list(token[1:-1]) if token[0] == "[" else [""] if token.endswith("?") else [token]
            forms = [f + c for f in forms for c in choices]
        out += forms
    return out


@lru_cache(maxsize=1)
def _guards() -> tuple:
    """What a line must hold for number repair to change it; of each rule the sets of letters one of which a text must hold."""
    line = re.compile(P.python_pattern(f"[§ＳSBIl|｜O=:分]|[0-9]{P.WS}+[0-9]"))
    return line, [(*rule, [frozenset(f) for f in plain_variants(v)]) for rule, (v, _, _) in zip(_compiled()[3], P.VOCABULARY, strict=True)]


@lru_cache(maxsize=1)
def _rule_letters() -> frozenset:
    """Letters beyond ASCII of the vocabulary's forms, each of which has some."""
    forms = [f for *_, some in _guards()[1] for f in some]
    assert not any("".join(f).isascii() for f in forms)
    return frozenset(c for f in forms for c in f if not c.isascii())


@lru_cache(maxsize=1)
def _vocabulary_runs() -> re.Pattern:
    """Runs of letters of the rules and their terms, white space between: no match of a rule, earlier replacements made or not, reaches out of one."""
    letters = {c for v, term, _ in P.VOCABULARY for f in (*plain_variants(v), term) for c in f if c != " "}
    one = "".join(map(re.escape, sorted(letters)))
    return re.compile(f"[{one}][{one}{P.python_pattern(P.WS_CHARS)}]*[{one}]")


_KEPT_RUN = 200  # characters up to which a run's result is kept: runs hold no digits and few names, so there are few different ones


def _vocabulary_run(run: str) -> str:
    for pattern, term, _ in _compiled()[3]:
        run = pattern.sub(term, run)
    return run


def _vocabulary_run_counts(run: str) -> tuple[tuple[int, int], ...]:
    """(rule, matches) of the rules that match, each on the run as it is."""
    found = ((k, len(pattern.findall(run))) for k, (pattern, *_) in enumerate(_compiled()[3]))
    return tuple((k, n) for k, n in found if n)


_kept_run, _kept_counts = lru_cache(maxsize=1 << 14)(_vocabulary_run), lru_cache(maxsize=1 << 14)(_vocabulary_run_counts)


def _run_replaced(m: re.Match) -> str:
    return _kept_run(m[0]) if len(m[0]) <= _KEPT_RUN else _vocabulary_run(m[0])


def _vocabulary_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    runs = _vocabulary_runs()
    for texts in batches:
        yield pd.Series([None if t is None else runs.sub(_run_replaced, t) for t in texts], index=texts.index, dtype=object)


def _counts_of(text: str) -> list[int]:
    counts = [0] * len(P.VOCABULARY)
    for run in _vocabulary_runs().findall(text):
        for k, n in _kept_counts(run) if len(run) <= _KEPT_RUN else _vocabulary_run_counts(run):
            counts[k] += n
    return counts


def _vocabulary_count_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([None if t is None else _counts_of(t) for t in texts], index=texts.index, dtype=object)


_CONTEXT_FIRST = frozenset(x[0] for x in P.NUMBER_CONTEXT.split("|"))


def _chain(text: str) -> tuple[str, Counter, bool]:
    """(text, counts, whether a place was repaired). A rule runs only where the text has all letters of one of its forms: they are found in
    one pass, and a term that is put in adds its own."""
    context, number, place, _ = _compiled()
    touched, rules = _guards()
    counts: Counter = Counter()
    letters = set(text)
    if not letters.isdisjoint(_CONTEXT_FIRST) and context.search(text) and touched.search(text):
        lines = text.split("\n")
        for k, line in enumerate(lines):
            if touched.search(line) and context.search(line):
                for pattern, to in number:
                    lines[k] = pattern.sub(to, lines[k])
                counts[P.NUMBER_LABEL] += lines[k] != line
        text = "\n".join(lines)
    placed = place.sub(r"\1郡山市", text) if "都" in letters else text
    moved, text = placed != text, placed
    letters = set(text)
    for pattern, term, label, forms in () if letters.isdisjoint(_rule_letters()) else rules:
        if any(f <= letters for f in forms):
            text, n = pattern.subn(term, text)
            if n:
                counts[label] += n
                letters.update(term)
    return text, counts, moved


def _count_chain(text: str) -> tuple[str, dict[str, int]]:
    text, counts, moved = _chain(text)
    counts[P.PLACE_LABEL] += moved
    return text, {k: v for k, v in counts.items() if v}


def _chain_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([_count_chain(t or "") for t in texts], columns=["text", "counts"], index=texts.index)


def vocabulary_chain(text: Column) -> Column:
    """struct(text, counts): number repair, place repair and the vocabulary in order, with each label's matches."""
    return F.pandas_udf(_chain_batches, "text string, counts map<string,int>")(text)


@lru_cache(maxsize=1)
def _around() -> tuple:
    """The steps before, between and after the two chains, compiled."""
    py, j = P.python_pattern, P.JOINED_CHARS
    sub = lambda pattern, to: (re.compile(py(pattern)), to)
    blanks = re.findall(py(P.WS), "".join(map(chr, range(0x10000))))
    fold = [list(zip(_FOLD_FROM[:n], _FOLD_TO[:n], strict=True)) for n in (len(_FOLD_FROM), -2)]
    ahead = [(*sub(f"([0-9]){P.WS}*[=:]{P.WS}*([0-9])", r"\1-\2"), set("=:")), (*sub(r"([0-9]+)\)", r"\1"), set(")")), (*sub(P.WS + "{2,}", " "), set(blanks))]
    pairs = ((f"[{j}]", f"[{j}]"), (f"[{j}]", "[0-9]"), ("[0-9]", "[0-9]"), ("[0-9]", "[年月日番号]"), ("[年月日番号]", "[0-9]"))
    kinds = {f"[{j}]": set(re.findall(f"[{j}]", "".join(map(chr, range(0x10000))))), "[0-9]": set("0123456789"), "[年月日番号]": set("年月日番号")}
    spaces = [*[(*sub(f"({left}){P.WS}+(?={right})", r"\1"), kinds[left], kinds[right]) for left, right in pairs], (*sub(P.WS + "{2,}", " "), set(blanks), set(blanks))]
    any_ = "[^\n\r\x85\u2028\u2029]*?"  # what . stands for in Java
    labels = [(re.compile(py(P.spaced(v)).replace(".*?", any_)), term, frozenset(x[0] for x in v.split("|"))) for v, term in P.LABEL_RULES]
    return "".join(blanks), fold, ahead, spaces, labels


def _tokens(variant: str) -> list[str]:
    return re.findall(r"(?:\[[^\]]*\]|\\.|.)(?:\*\?|\?)?", variant)


def _letters_of(token: str) -> set[str]:
    return set(token[1:].rstrip("?*").rstrip("]")) if token[0] == "[" else {token[1] if token[0] == "\\" else token[0]}


@lru_cache(maxsize=1)
def _unit_end() -> re.Pattern:
    """Line ends that no step of the normaliser reaches across.

    The steps are of one line but for rules with white space between letters, digits joined over a sign, and runs of white space. Such a rule
    reaches across only where the letter before the line end may stand before white space of a rule, and the one behind it behind; letters
    that an earlier rule may turn into such ones count as well.
    """
    rules = [(_tokens(v), term) for variants, term, *_ in (*P.VOCABULARY, *P.LABEL_RULES) for v in variants.split("|")]
    before, behind = {"在"}, {"都"}  # of the place repair
    for tokens, _ in rules:
        for k, t in enumerate(tokens):
            if t == "_":
                before |= _letters_of(tokens[k - 1])
                behind |= _letters_of(tokens[k + 1])
    grown = None
    while grown != (grown := (len(before), len(behind))):
        for tokens, term in rules:
            if term[-1] in before:
                before |= _letters_of(tokens[-1]) | (_letters_of(tokens[-2]) if tokens[-1].endswith("?") else set())
            if term[0] in behind:
                behind |= _letters_of(tokens[0])
    one = lambda letters: "[" + "".join(map(re.escape, sorted(letters))) + "]"
    solid, digit = f"[^{P.python_pattern(P.WS_CHARS)}|｜]", "[0-9０-９=:]"
    apart = lambda a, b: f"(?:(?<!{a}\n)|(?!{b}))"
    return re.compile(f"\n(?<={solid}\n)(?={solid}){apart(one(before), one(behind))}{apart(digit, digit)}")  # the line end first: it is sought fast


def _replaced(text: str, letters: list[tuple[str, str]]) -> str:
    """Letters replaced one by one: none of the new ones is an old one of a later pair that would change it again."""
    for a, b in letters:
        if a in text:
            text = text.replace(a, b)
    return text


def _normal_unit(text: str) -> tuple[str, str, tuple, bool, bool]:
    """(normalize_ocr, normalize_text, counts of both chains, place repaired by the first, by the second) of a unit of lines."""
    blanks, (fold, fold_again), ahead, spaces, labels = _around()
    text = _replaced(text, fold)
    letters = set(text)
    for pattern, to, needed in ahead:
        if not needed.isdisjoint(letters):
            text = pattern.sub(to, text)
    text, counts, moved = _chain(text)
    lines = text.split("\n")
    for k, line in enumerate(lines):
        letters = set(line)
        for pattern, to, left, right in spaces:
            if not (letters.isdisjoint(left) or letters.isdisjoint(right)):
                line = pattern.sub(to, line)
        lines[k] = line.strip(blanks)
    text, more, moved_again = _chain("\n".join(lines))
    counts.update(more)
    text = re.sub("\n{2,}", "\n", text).strip(blanks)
    named = re.sub("[ \t]+", " ", text) if "\t" in text or "  " in text else text
    named = re.sub("\n{2,}", "\n", _replaced(named, fold_again)).strip(blanks)
    letters = set(named)
    for pattern, term, firsts in labels:
        if firsts & letters:
            named, n = pattern.subn(term, named)
            if n:
                letters.update(term)
    return text, named, tuple((k, v) for k, v in counts.items() if v), moved, moved_again


_KEPT_UNIT = 200  # characters up to which a unit's result is kept: certificates say the same lines again and again
_kept_unit = lru_cache(maxsize=1 << 16)(_normal_unit)


def _units(text: str | None) -> list[tuple]:
    return [_kept_unit(u) if len(u) <= _KEPT_UNIT else _normal_unit(u) for u in _unit_end().split(text or "")]


def _ocr_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(["\n".join([u[0] for u in _units(t)]) for t in texts], index=texts.index, dtype=object)


def _label_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series(["\n".join([u[1] for u in _units(t)]) for t in texts], index=texts.index, dtype=object)


def _reported(text: str | None) -> tuple[str, dict[str, int]]:
    units = _units(text)
    counts: Counter = Counter()
    for u in units:
        for label, n in u[2]:
            counts[label] += n
    for k in (3, 4):  # a chain repairs the place of a text once
        if any(u[k] for u in units):
            counts[P.PLACE_LABEL] += 1
    return "\n".join([u[0] for u in units]), dict(counts)


def _report_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([_reported(t) for t in texts], columns=["text", "corrections"], index=texts.index)


def normalize_with_report(text: Column) -> Column:
    """struct(text, corrections map<label,count>): the whole normaliser with counts of both passes."""
    return F.pandas_udf(_report_batches, "text string, corrections map<string,int>")(text)
