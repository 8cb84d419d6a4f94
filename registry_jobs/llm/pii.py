"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. Suspects are tokens of like shape which the patterns leave: numbers in
other notations, disguised addresses. Base spans and suspects of a document are the nodes of a field:
neighbours in the text share a chain potential, and equal or similar tokens, however far apart, a skip
potential. Loopy message passing lets a confirmed token lend its label to its other spellings; suspects
whose belief passes a threshold are added. All weights are counted over all documents: those of features with
base spans as positive and suspects as negative examples, those of pairs by how often two base spans that they
join have one kind, against chance. All documents of a slice form one graph for numpy.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from registry_jobs.llm.common import dropped, text_or_empty, written

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NUMBERS = re.compile(r"\(?[0-9](?:[ ().\-/]{0,3}[0-9]){6,}+")
_AT = re.compile(r" ?(?:@|\(at\)|\[at\]|＠| at ) ?", re.IGNORECASE)
_HOST = re.compile(r"[A-Za-z0-9-]++(?: ?(?:\.|\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)+", re.IGNORECASE)
NEAR = 80  # code points within which neighbours share a chain potential


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ with a domain takes the run of local characters before it, back to the last match."""
    last, at = 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at) if at > last else None
        start = at
        if m:
            while start > last and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if text.count(".") > 2:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() > 11 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Plain and disguised addresses: each at-sign with a host takes the run of local characters before it, back to the last match."""
    last = 0
    for m in _AT.finditer(text):
        start = m.start()
        host = _HOST.match(text, m.end()) if start >= last else None
        while host and start > last and text[start - 1] in _LOCAL:
            start -= 1
        if host and start < m.start():
            yield start, host.end()
            last = host.end()


def suspects(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of tokens of like shape that overlap no base span and no suspect before them."""
    found = []
    if _DIGIT.search(text):
        found += [m.span() for m in _NUMBERS.finditer(text)]
    if "@" in text or "＠" in text or re.search(r"[(\[]at[)\]]| dot ", text, re.IGNORECASE):
        found += addresses(text)
    out, taken, k = [], sorted((s, e) for s, _, e in base), 0
    last = 0
    for s, e in sorted(found):
        while k < len(taken) and taken[k][1] <= s:
            k += 1
        if s >= last and (k == len(taken) or taken[k][0] >= e) and not (k and taken[k - 1][1] > s):
            out.append((s, e))
            last = e
    return out


def identities(token: str) -> list[str]:
    """What equal or similar tokens share: all digits, their last seven, or the plain address."""
    plain = re.sub(r"\s*(?:\(at\)|\[at\]|＠| at )\s*", "@", token.lower())
    plain = re.sub(r"\s*(?:\(dot\)|\[dot\]| dot )\s*", ".", plain).replace(" ", "")
    if "@" in plain:
        return ["@" + plain]
    d = digits_of(token)
    return ["#" + d, "~" + d[-7:]] if len(d) >= 7 else []


def shape(text: str, start: int, end: int) -> list[str]:
    """Features of a token and of the word before it."""
    token = text[start:end]
    d = digits_of(token)
    before = text[max(0, start - 24) : start].split()
    return [
        f"digits={len(d)}",
        "luhn" if len(d) > 11 and luhn(d) else "no luhn",
        "plus" if token[:1] == "+" else "no plus",
        f"dots={min(token.count('.'), 4)}",
        "at" if "@" in token else "no at",
        "brackets" if "(" in token else "no brackets",
        "blanks" if " " in token else "no blanks",
        "hyphens" if "-" in token else "no hyphens",
        "word=" + (before[-1].lower().strip(".,:;") if before else ""),
    ]


#: What is believed before any pair is counted, as so many pairs: the share of pairs with one kind among
#: neighbours (chance), among equal tokens (#, @) and among numbers with equal last digits (~).
PAIRS_BEFORE = 10.0
SHARE_BEFORE = {"chain": 0.25, "#": 0.999, "@": 0.999, "~": 0.99}
NONE_BEFORE = 7.4  # suspects that are nothing for each of a kind


def log_odds(share: float) -> float:
    return math.log(share / (1 - share))


def potential(name: str, same: float = 0.0, other: float = 0.0, chance: float = 0.25) -> float:
    """How much more than by chance the two ends of a pair have one label."""
    before = SHARE_BEFORE[name]
    return math.log((same + PAIRS_BEFORE * before) / (other + PAIRS_BEFORE * (1 - before))) - log_odds(chance)


@dataclass
class Field:
    """Weights of the field: unary log-odds of each feature by label, the labels' bias, and the potentials of pairs. Base spans are observed: their label is fixed."""

    unary: dict[str, np.ndarray] = field(default_factory=dict)
    bias: np.ndarray = field(default_factory=lambda: np.array([math.log(NONE_BEFORE), 0.0, 0.0, 0.0, 0.0]))
    pairs: dict[str, float] = field(default_factory=lambda: {name: potential(name) for name in SHARE_BEFORE})
    observed: float = 30.0
    rounds: int = 12
    threshold: float = 0.7


def solve(unary: np.ndarray, edges: np.ndarray, strength: np.ndarray, rounds: int) -> np.ndarray:
    """Beliefs of each node by loopy sum-product: edges (m, 2) with a bonus `strength` where labels agree."""
    n, k = unary.shape
    if not len(edges):
        b = np.exp(unary - unary.max(1, keepdims=True))
        return b / b.sum(1, keepdims=True)
    src = np.concatenate([edges[:, 0], edges[:, 1]])
    dst = np.concatenate([edges[:, 1], edges[:, 0]])
    s = np.concatenate([strength, strength])[:, None]
    m = len(edges)
    back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
    message = np.zeros((2 * m, k))
    for _ in range(rounds):
        total = unary.copy()
        np.add.at(total, dst, message)
        out = total[src] - message[back]
        out -= out.max(1, keepdims=True)
        e = np.exp(out)
        new = np.log(e.sum(1, keepdims=True) + e * (np.exp(s) - 1))
        new -= new.mean(1, keepdims=True)
        message = 0.5 * message + 0.5 * new
    total = unary.copy()
    np.add.at(total, dst, message)
    b = np.exp(total - total.max(1, keepdims=True))
    return b / b.sum(1, keepdims=True)


def linked(text: str, own: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(earlier, later, name) of the pairs of tokens: neighbours, and each token with the last one of the same identity."""
    last: dict[str, int] = {}
    for j, (s, e, _) in enumerate(own):
        if j and s - own[j - 1][1] <= NEAR:
            yield j - 1, j, "chain"
        for name in identities(text[s:e]):
            if name in last:
                yield last[name], j, name[0]
            last[name] = j


def label_texts(texts: list[str], model: Field) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, each (start, kind, end)."""
    rows, nodes, unary, edges, strength = [], [], [], [], []
    for t, text in enumerate(texts):
        base = base_spans(text)
        more = suspects(text, base)
        rows.append((base, []))
        if not more:
            continue
        own = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in more])
        first = len(nodes)
        for s, e, k in own:
            nodes.append((t, s, e, k))
            u = model.bias.copy()
            if k:
                u = np.zeros(len(LABELS))
                u[k] = model.observed
            else:
                for f in shape(text, s, e):
                    u = u + model.unary.get(f, 0.0)
            unary.append(u)
        for a, b, name in linked(text, own):
            edges.append((first + a, first + b))
            strength.append(model.pairs[name])
    if nodes:
        belief = solve(np.array(unary), np.array(edges, dtype=np.int64).reshape(-1, 2), np.array(strength), model.rounds)
        for (t, s, e, k), b in zip(nodes, belief, strict=True):
            best = int(b.argmax())
            if not k and best and b[best] >= model.threshold:
                rows[t][1].append((s, best - 1, e))
    return rows


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_share: float = 1e-5) -> Field:
    """The field's weights from all documents. A feature counts from least_share of all counts, and from five, on: at most 1 / least_share come to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def counted() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array([seen[x] for x in keys], pa.int64())], names=["feature", "label", "n"]
            )

        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                base = base_spans(text)
                own = sorted([(s, e, k + 1) for s, k, e in base] + [(s, e, 0) for s, e in suspects(text, base)])
                for s, e, k in own:
                    seen.update((f, k) for f in ["", *shape(text, s, e)])
                for a, b, name in linked(text, own):
                    if own[a][2] and own[b][2]:
                        seen[f"pair {name}", int(own[a][2] == own[b][2])] += 1
                if len(seen) > 100_000:
                    yield counted()
                    seen.clear()
        yield counted()

    tokens = docs.select(text_or_empty(text_col).alias("text")).mapInArrow(count, "feature string, label int, n long")
    counts = written(tokens.groupBy("feature", "label").agg(F.sum("n").alias("n")))
    least = max(5.0, least_share * (counts.agg(F.sum("n")).first()[0] or 0))
    table: dict[str, np.ndarray] = {}
    for r in counts.where((F.col("n") >= least) | F.col("feature").startswith("pair ") | (F.col("feature") == "")).collect():
        table.setdefault(r["feature"], np.zeros(len(LABELS)))[r["label"]] = r["n"]
    dropped(counts)
    model = Field()
    total = table.pop("", np.zeros(len(LABELS)))
    kinds = total[1:] + PAIRS_BEFORE / len(KINDS)
    chance = float(((kinds / kinds.sum()) ** 2).sum())
    for name in SHARE_BEFORE:
        other, same = table.pop(f"pair {name}", np.zeros(len(LABELS)))[:2]
        model.pairs[name] = potential(name, same, other, chance)
    model.bias[0] = math.log((total[0] + PAIRS_BEFORE * NONE_BEFORE) / (total[1:].mean() + PAIRS_BEFORE))
    total = total + 1
    for f, n in table.items():
        share = np.log((n + 0.5) / (total + 1.0))
        # damped, as the features overlap and base spans follow from some of them by definition
        model.unary[f] = np.clip(0.25 * (share - share.mean()), -1.0, 1.0)
    return model


def _text_of(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find_personal_data(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added: one row per row of docs.

    Counts and the digest are of base spans; spans has these and the added ones. A null text is empty.
    Null ids and repeated rows pass through; an empty table gives an empty result; other columns are not read.
    Rows never meet: no shuffle. A text of any length is read whole. Equal tokens link to their last occurrence only, so a long document's graph stays linear in it.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, size, first = [], 0, 0
            for j, t in enumerate(batch.column(1)):
                texts.append(t.as_py())
                size += len(texts[-1])
                if size < 1 << 20 and j + 1 < batch.num_rows:
                    continue
                got = label_texts(texts, model)
                counts = [[sum(1 for x in base if x[1] == k) for base, _ in got] for k in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        *[pa.array(c, pa.int64()) for c in counts],
                        pa.array([hashlib.sha256(_text_of(base).encode()).hexdigest() for base, _ in got], pa.string()),
                        pa.array([_text_of(sorted(base + more)) for base, more in got], pa.string()),
                        pa.array([len(more) for _, more in got], pa.int64()),
                    ],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )
                first += len(texts)
                texts, size = [], 0

    cols = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return cols.mapInArrow(rows, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first counts."""
    out, at = [], 0
    for kind, s, e in (x.split(":") for x in spans.split(",") if x):
        if int(s) >= at:
            out += [text[at : int(s)], f"[{kind}]"]
            at = int(e)
    return "".join([*out, text[at:]])
