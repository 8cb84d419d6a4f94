"""The library's functions for SQL: column functions by name, and lines and entries as table functions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P
from registry_jobs.functions import predicates as C
from registry_jobs.functions import text as T
from registry_jobs.sources.exports import has_enough_text

#: Functions of one text that Spark writes as SQL of its own: they stay in the JVM and are inlined like any expression. None may
#: hold a function of its own, as let() does, for Spark has no SQL for those.
COLUMNS: dict[str, Callable[[Column], Column]] = {
    "fold_chars": T.fold_chars,
    "join_digit_separators": T.join_digit_separators,
    "collapse_ws": T.collapse_ws,
    "clean_value": T.cleaned,
    "clip_text": T.clip_text,
    "has_enough_text": has_enough_text,
    "is_header": C.is_header,
    "is_excluded_right": C.is_excluded_right,
    "looks_like_corp": C.looks_like_corp,
    "looks_like_address": C.looks_like_address,
    "has_contamination": C.has_contamination,
    "has_noise_token": C.has_noise_token,
}


def _sql_of(spark: SparkSession, made: Column) -> tuple[str, str]:
    """The expression in SQL, and its type."""
    plan = spark.createDataFrame([], "text string").select(made.alias("made"))
    (kind,) = (k for _, k in plan.dtypes)
    return plan._jdf.queryExecution().analyzed().projectList().head().child().sql(), kind


@lru_cache(maxsize=1)
def _line_rules() -> tuple:
    ws, chars = P.python_pattern(P.WS), P.python_pattern(P.WS_CHARS)
    table = str.maketrans(dict(zip("|｜()（）【】「」『』‐‑‒–—―", " " * 12 + "-" * 6, strict=True)))
    head, runs, ends = re.compile(f"^[:：・\\-{chars}]+"), re.compile(ws + "{2,}"), re.compile(f"^{ws}+|{ws}+\\Z")
    some = re.compile(P.python_pattern(f"[{P.KANJI_KANA_CHARS}a-zA-Z0-9]"))
    noise = re.compile("([^\n\r\u0085\u2028\u2029])\\1{6}|^[a-zA-Z0-9]{1,2}\\Z")
    return table, head, runs, ends, some, noise


def kept_lines(text: str) -> list[str]:
    """Cleaned lines of a text that hold something and aren't noise: the small helper of the table function."""
    table, head, runs, ends, some, noise = _line_rules()
    cleaned = (ends.sub("", runs.sub(" ", head.sub("", line.translate(table)))) for line in text.split("\n"))
    return [line for line in cleaned if line and some.search(line) and not noise.search(line)]


class LinesOf:
    """lines_of(text): (line_no, line), as the operator of this name."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        yield from enumerate(kept_lines(text or ""))


def register(spark: SparkSession) -> list[str]:
    """Make the functions callable in this session's SQL, as temporary ones; returns their names.

    Beside the column functions: normalize_ocr(text) with its counts as struct(text, corrections), a vectorised function,
    and the table function lines_of(text).
    """
    for name, f in COLUMNS.items():
        body, kind = _sql_of(spark, f(F.col("text")))
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS {kind} RETURN {body}")
    spark.udf.register("vocabulary_chain", F.pandas_udf(T._chain_batches, "text string, counts map<string,int>"))
    spark.udtf.register("lines_of", F.udtf(LinesOf, returnType="line_no int, line string"))
    return [*COLUMNS, "vocabulary_chain", "lines_of"]
