"""Byte-pair encoding and decoding by batched numpy merge rounds.

The vocabulary is read from a tokenizer file named by a parameter. Texts are cut into words as the
file's normaliser and pre-tokenizer say; the distinct words of a batch which are not known yet are
encoded together: their symbols lie in one flat array, and in each round every word's lowest-ranked
pair, found by binary search over the sorted pair keys, is merged at all its places at once.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = np.int64(1) << 40
_SPACES = regex.compile(r"\p{White_Space}+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class WordBpe:
    """Encoder and decoder of a lower-casing word-end BPE file, as its tokenizers library reads it."""

    def __init__(self, path: str, most_words: int = 100_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters])
        self.last = np.array([vocab[c + end] for c in letters])
        self.width = len(self.tokens)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in merges], dtype=np.int64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.most_words = most_words
        self.known: dict[str, tuple[str, int, str]] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], _NONE)

    def merge_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each word) of words that aren't empty."""
        raw = [w.encode() for w in words]
        lengths = np.array([len(b) for b in raw])
        flat = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.first[flat]
        ends = np.cumsum(lengths)
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lengths)
        done_symbols, done_owner = [], []
        while len(symbols) > 1:
            rank = np.full(len(symbols), _NONE)
            inside = owner[:-1] == owner[1:]
            rank[:-1][inside] = self.ranks(symbols[:-1][inside], symbols[1:][inside])
            starts = np.flatnonzero(np.concatenate(([True], ~inside)))
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(symbols))))
            open_ = best < _NONE
            if not open_.all():  # words without a pair left are ready
                done_symbols.append(symbols[~open_])
                done_owner.append(owner[~open_])
                symbols, owner, rank, best = symbols[open_], owner[open_], rank[open_], best[open_]
                if not len(symbols):
                    break
            hit = rank == best
            # in a run of overlapping hits (aaaa) every second one counts, from the left
            at = np.flatnonzero(hit)
            fresh = np.concatenate(([True], np.diff(at) > 1))
            run = at - at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[run % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = self.merged[rank[at]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        done_symbols.append(symbols)
        done_owner.append(owner)
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.bincount(owner, minlength=len(words))

    def learn(self, tokens: set[str]) -> None:
        """Encode tokens without white space into self.known: ids as text, how many, vocabulary entries as text."""
        todo = [(t, self.words.findall(t)) for t in tokens]
        for a in range(0, len(todo), 1 << 14):
            part = todo[a : a + (1 << 14)]
            distinct = sorted({w for _, ws in part for w in ws}, key=len)
            ids, counts = self.merge_rounds(distinct) if distinct else (np.zeros(0, int), np.zeros(0, int))
            ids, ends = ids.tolist(), np.cumsum(counts).tolist()
            own = {w: ids[e - n : e] for w, e, n in zip(distinct, ends, counts.tolist(), strict=True)}
            for t, ws in part:
                got = [i for w in ws for i in own[w]]
                self.known[t] = (" ".join(map(str, got)), len(got), " ".join([self.tokens[i] for i in got]))
            self.known.update({"\n" + s: (str(i), 1, s) for s, i in self.special.items()})

    def pieces(self, text: str) -> list[str]:
        """The normalised tokens of a text between white space; special tokens after a line feed, which no other has."""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out = []
        for k, part in enumerate(self.marks.split(text)):
            out.extend(["\n" + part] if k % 2 else self._plain(part))
        return out

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        # str.split() also parts at U+001C to U+001F, which aren't white space in Unicode's list
        return [t for t in _SPACES.split(text) if t] if _SEPARATORS.search(text) else text.split()

    def encode_rows(self, texts: list[str]) -> Iterator[tuple[str, int, str]]:
        """(ids joined by a space, their number, tokens joined by a space) of each text."""
        rows = [self.pieces(t) for t in texts]
        distinct = set().union(*rows)
        new = distinct - self.known.keys()
        if new and len(self.known) + len(new) > self.most_words:
            self.known.clear()
            new = distinct
        if new:
            self.learn(new)
        known = self.known
        for row in rows:
            found = [f for w in row if (f := known[w])[1]]
            yield " ".join([f[0] for f in found]), sum([f[1] for f in found]), " ".join([f[2] for f in found])

    def decode(self, ids: str) -> str:
        """The text that ids, joined by a space, stand for: tokens joined by a space, as the file has no decoder."""
        return " ".join([self.tokens[int(i)] for i in ids.split()])


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder a worker process."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _slices(column: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    texts, size = [], 0
    for t in column:
        texts.append(t.as_py() or "")
        size += len(texts[-1])
        if size >= most:
            yield texts
            texts, size = [], 0
    if texts:
        yield texts


def _apply(path: str, digest: bool):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for batch in batches:
            at = 0
            for texts in _slices(batch.column(1)):
                got = list(bpe.encode_rows(texts))
                ids, n, tokens = zip(*got, strict=True)
                if digest:
                    sha = lambda xs: pa.array([hashlib.sha256(x.encode()).hexdigest() for x in xs], pa.string())
                    more = [sha(ids), sha(tokens)]
                else:
                    more = [pa.array([[int(i) for i in x.split()] for x in ids], pa.list_(pa.int32())), pa.array(tokens, pa.string())]
                own = batch.column(0).slice(at, len(texts))
                at += len(texts)
                yield pa.RecordBatch.from_arrays([own, pa.array(n, pa.int64()), *more], names=["doc_id", "n_tokens", "a", "b"])
        bpe.known.clear()

    return apply


def _run(docs: DataFrame, path: str | None, id_col: str, text_col: str, digest: bool, schema: str) -> DataFrame:
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_apply(path or default_path(), digest), schema)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array<int>), decoded: one row per row of docs.

    path: the tokenizer file, at the same place on every node. A null text is empty and has no ids; null
    ids and repeated rows pass through; other columns are not read. Rows never meet, so there is no
    shuffle; a worker keeps at most 100,000 words, then begins its store anew, and none after its rows.
    """
    return _run(docs, path, id_col, text_col, False, "doc_id long, n_tokens long, ids array<int>, decoded string")


def encode_digest(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode(), with SHA-256 digests of the ids (decimal, joined by one space) and of the decoded text."""
    return _run(docs, path, id_col, text_col, True, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from (doc_id, ids array<int>); null ids decode to an empty text."""
    where = path or default_path()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(where)
        for batch in batches:
            texts = [bpe.decode(" ".join(map(str, ids or []))) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(apply, "doc_id long, text string")
