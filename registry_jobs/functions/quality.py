"""Quality of a reading: what its text holds, and what that is good for."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from registry_jobs.functions import patterns as P


@lru_cache(maxsize=1)
def _classes() -> list[np.ndarray]:
    """By code point: white space, Japanese, alphanumeric, of words, Latin letter; the last place is for all beyond the basic plane."""
    every = "".join(map(chr, range(0x10000)))
    out = []
    for pattern in (P.WS, P.JAPANESE, P.ALNUM, "[0-9A-Za-z_]", "[A-Za-z]"):
        found = np.zeros(0x10001, dtype=bool)
        found[[m.start() for m in re.finditer(P.python_pattern(pattern), every)]] = True
        out.append(found)
    return out


_LABEL_FORMS = [[x[0] + c for c in x[2:-1]] if "[" in x else [x] for x in P.QUALITY_LABELS]


def _measured(texts: Sequence[str]) -> pd.DataFrame:
    """text_quality() of texts, their characters looked up and added up by line in one pass."""
    space, japanese, alnum, word, letter = _classes()
    code = np.minimum(np.frombuffer("".join(t + "\n" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4"), 0x10000)
    line_at = np.concatenate(([0], np.flatnonzero(code == 10)[:-1] + 1))
    size = np.array([len(t) + 1 for t in texts])
    text_at = np.searchsorted(line_at, np.cumsum(size) - size)
    by_line = lambda mask: np.add.reduceat(mask, line_at, dtype=np.int64)
    by_text = lambda x: np.add.reduceat(x, text_at, dtype=np.int64)
    solid, jp, ascii_ = ~space[code], by_line(japanese[code]), by_line(alnum[code])
    n = by_line(solid)
    symbol = n - jp - ascii_
    edge = np.diff(word[code].astype(np.int8), prepend=0)  # a text ends with a line end, so a run of letters does
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    letters = np.concatenate(([0], np.cumsum(letter[code])))
    whole = (end - begin >= 4) & (letters[end] - letters[begin] == end - begin)
    words = np.bincount(np.searchsorted(line_at, begin[whole], side="right") - 1, minlength=len(line_at))
    foreign = (jp == 0) & ((ascii_ >= n * 0.55) | (symbol >= n * 0.35))
    garbage, lines = by_text((n >= 4) & (foreign | (words >= 2))), by_text(n > 0)
    n, jp, ascii_, symbol, words = by_text(n), by_text(jp), by_text(ascii_), by_text(symbol), by_text(words)
    compacted, at = code[solid].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass"), np.concatenate(([0], np.cumsum(n))).tolist()
    labels = np.array([sum(any(f in c for f in forms) for forms in _LABEL_FORMS) for c in (compacted[a:b] for a, b in zip(at, at[1:]))])
    m = np.maximum(n, 1).astype(float)
    score = np.minimum(n / 6.0, 45.0) + jp / m * 80 + labels * 22 - ascii_ / m * 35 - symbol / m * 35 - words * 8 - garbage * 15
    return pd.DataFrame({"score": score, "label_count": labels, "japanese_ratio": jp / m, "noise_ratio": (ascii_ + symbol) / m, "garbage_lines": garbage, "length": n, "line_count": lines})


def _quality_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        texts, found, begin = [t or "" for t in batch], [], 0
        size = np.cumsum([len(t) for t in texts])
        while begin < len(texts):  # about a million characters at a time
            end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + (1 << 20), side="right")))
            found.append(_measured(texts[begin:end]))
            begin = end
        yield pd.concat(found, ignore_index=True) if found else pd.DataFrame(columns=[f.split()[0] for f in _QUALITY.split(", ")])


_QUALITY = "score double, label_count int, japanese_ratio double, noise_ratio double, garbage_lines int, length int, line_count int"


def text_quality(text: Column) -> Column:
    """struct(score, label_count, japanese_ratio, noise_ratio, garbage_lines, length, line_count): one vectorised pass over the characters."""
    return F.pandas_udf(_quality_batches, _QUALITY)(text)


def is_usable(q: Column, source: Column) -> Column:
    base = (q["length"] >= 40) & (q["label_count"] >= 1) & (q["japanese_ratio"] >= 0.18) & (q["garbage_lines"] < 8)
    ocr = (q["score"] >= 55) & (q["label_count"] >= 2) & (q["garbage_lines"] <= 3)
    return base & F.when(source.startswith("ocr-"), ocr).otherwise(q["score"] >= 45)


def is_previewable(q: Column) -> Column:
    swamped = (q["line_count"] > 0) & (q["garbage_lines"] >= F.greatest(F.lit(10.0), q["line_count"] * 0.8))
    return (q["length"] >= 20) & ~swamped & ((q["score"] >= 5) | (q["label_count"] >= 1) | (q["japanese_ratio"] >= 0.05))


def is_strong(q: Column) -> Column:
    return (q["score"] >= 85) & (q["label_count"] >= 3) & (q["garbage_lines"] <= 2)


def preview_score(q: Column) -> Column:
    return q["score"] + F.least(q["length"] / F.lit(8.0), F.lit(60.0)) + q["label_count"] * 12 - q["garbage_lines"] * 6


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def normalization_summary(before: Column, after: Column) -> Column:
    """Four lines on what normalisation changed."""
    s = lambda x: x.cast("string")
    percent = lambda x: F.concat(s(js_round(x * 100)), F.lit("%"))
    return F.array(
        F.concat(F.lit("正規化前スコア: "), s(js_round(before["score"])), F.lit(" / 後: "), s(js_round(after["score"]))),
        F.concat(F.lit("ラベル数: "), s(before["label_count"]), F.lit(" → "), s(after["label_count"])),
        F.concat(F.lit("日本語率: "), percent(before["japanese_ratio"]), F.lit(" → "), percent(after["japanese_ratio"])),
        F.concat(F.lit("ノイズ率: "), percent(before["noise_ratio"]), F.lit(" → "), percent(after["noise_ratio"])),
    )
