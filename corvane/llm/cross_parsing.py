"""Language identification by cross-parsing (operator 2).

For each language a suffix automaton of labelled text is built, and laid out as one dense
table: from each state, each symbol leads to the next state, or, where the match can't be
extended, closes the phrase and leads to where the symbol starts a new one. The phrases that a
text falls into, each the longest match in the language's text, times the logarithm of that
text's length and for each symbol, are the cross-parsing entropy. The language with the least wins.

Symbols are letters and marks in lower case, the bytes of letters that are rare in all languages
together, and one separator for each run of anything else. Texts are parsed many at a time in step; one of
over ``STRETCH`` symbols is parsed in stretches of that many, so that a phrase also ends at
a stretch's end, which adds at most one phrase in 8192 symbols, in all languages alike.
"""

from __future__ import annotations

import functools
import math
import unicodedata
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.arrays import lengths_to_rows, map_texts, with_own_names
from corvane.llm.training_rows import held_out, sample_texts

#: Learnt from, for each language: at most so many texts, none over so many bytes, so many characters in all.
SAMPLE, LONGEST, TRAINING = 64, 1 << 15, 40_000
#: Characters learnt from over all languages, and letters with a symbol of their own; the others are spelt by their bytes.
ALL_TRAINING, LETTERS = 1_000_000, 120
STRETCH = 8192
#: Symbols that are parsed in step at a time, and texts.
GRID, LANES = 1 << 20, 8192
UNKNOWN = "und"

SEPARATOR, OTHER = 0, 1


@functools.cache
def letters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: whether it is a letter, or a letter or mark, and its lower case."""
    letter, word = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        kind = unicodedata.category(c := chr(i))[0]
        if kind == "L":
            letter[i] = word[i] = True
            if (low := c.lower()) != c:
                lower[i] = ord(low[0])
        elif kind == "M":
            word[i] = True
    return letter, word, lower


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in a row, and offsets."""
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), at


def normalised(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters and marks, 0 for each run of others; offsets; and how many letters each text has."""
    points, at = code_points(texts)
    letter, word, lower = letters()
    is_word = word[points]
    first = np.ones(len(points), bool)
    first[1:] = is_word[:-1]
    starts = at[:-1][at[:-1] < len(points)]
    first[starts] = True
    take = is_word | first
    total = np.concatenate([[0], np.cumsum(take)])
    n_letters = np.concatenate([[0], np.cumsum(letter[points])])
    return np.where(is_word, lower[points], 0)[take], total[at], n_letters[at[1:]] - n_letters[at[:-1]]


def suffix_automaton(symbols: Sequence[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start, and every factor of the symbols is a path from it."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(moves)
        moves.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = new
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[q] != length[p] + 1:
                copy = len(moves)
                moves.append(dict(moves[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
            else:
                link[new] = q
        last = new
    return moves


class CrossParser:
    """The languages' tables. Without languages everything is UNKNOWN."""

    def __init__(self, by_language: dict[str, Sequence[str]], budget: int = TRAINING):
        self.languages = sorted(by_language)
        most = max(1000, min(budget, ALL_TRAINING // max(1, len(self.languages))))
        streams = []
        for lang in self.languages:
            points, at, _ = normalised(by_language[lang])
            own, size = [], 0
            for a, b in zip(at[:-1], at[1:], strict=True):  # whole texts that fit, or else the start of the first
                if size + (b - a) <= most:
                    own.append(points[a:b])
                    size += b - a
            streams.append(np.concatenate(own) if own else points[:most])
        counts = Counter(x for s in streams for x in s.tolist() if x)
        common = sorted(counts, key=lambda x: (-counts[x], x))[:LETTERS]
        rest = sorted({b for x in counts.keys() - set(common) for b in chr(x).encode("utf-8", "surrogatepass")})
        self.symbols = {x: i for i, x in enumerate(common, OTHER + 1)} | {0: SEPARATOR}
        self.bytes = {b: i for i, b in enumerate(rest, OTHER + 1 + len(common))}
        self.width = OTHER + 1 + len(common) + len(rest)
        streams = [self.spelt(s, np.array([0, len(s)]))[0] for s in streams]
        tables, base, self.roots, self.weights = [], 0, [], []
        for s in streams:
            moves = suffix_automaton(s.tolist())
            table = np.empty((len(moves), self.width), np.int64)
            start = np.full(self.width, base << 1 | 1, np.int64)  # an unseen symbol closes the phrase it ends
            for c, q in moves[0].items():
                start[c] = (base + q * self.width) << 1 | 1
            table[:] = start
            for q, row in enumerate(moves):
                for c, to in row.items():
                    table[q, c] = (base + to * self.width) << 1
            tables.append(table.ravel())
            self.roots.append(base)
            self.weights.append(math.log2(max(2, len(s))))
            base += table.size
        self.table = np.concatenate(tables).astype(np.int32 if base < 1 << 30 else np.int64) if tables else np.zeros(0, np.int32)

    def spelt(self, points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of normalised texts, and their offsets."""
        if not hasattr(self, "codes"):
            self.codes = np.full(0x110000, OTHER, np.uint8)
            for x, i in self.symbols.items():
                self.codes[x] = i
        codes = self.codes[points]
        rare = np.flatnonzero(codes == OTHER)
        if not len(rare):
            return codes, at
        spelt = [np.array([self.bytes.get(b, OTHER) for b in chr(x).encode("utf-8", "surrogatepass")], np.uint8) for x in points[rare].tolist()]
        size = np.ones(len(points), np.int64)
        size[rare] = [len(x) for x in spelt]
        place = np.concatenate([[0], np.cumsum(size)])
        out = np.repeat(codes, size)
        into = np.repeat(place[rare], size[rare]) + np.concatenate([np.arange(len(x)) for x in spelt])
        out[into] = np.concatenate(spelt)
        return out, place[at]

    def entropies(self, points: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases x log2(training length) / symbols, texts by languages; inf for empty texts."""
        codes, at = self.spelt(points, at)
        n, langs = len(at) - 1, len(self.languages)
        sizes = np.diff(at)
        per_text = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(n), per_text)
        begin = at[owner] + STRETCH * (np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text))
        length = np.minimum(STRETCH, at[owner + 1] - begin)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        active = np.searchsorted(-length, -np.arange(int(length[0]) if len(length) else 0), side="left")  # how many stretches are longer than t
        phrases = np.zeros((langs, n), np.int64)
        table, padded = self.table, np.concatenate([codes, np.zeros(STRETCH, np.uint8)])
        lo = 0
        while lo < len(owner):
            hi = min(len(owner), lo + min(LANES, max(1, GRID // int(length[lo]))))
            grid = padded[begin[lo:hi, None] + np.arange(int(length[lo]))].T.astype(table.dtype, order="C")
            state = np.repeat(np.array(self.roots, table.dtype)[:, None], hi - lo, axis=1)
            count = np.ones((langs, hi - lo), np.int32)
            for t in range(int(length[lo])):
                m = min(hi, int(active[t])) - lo
                step = table[state[:, :m] + grid[t, :m]]
                count[:, :m] += step & 1
                state[:, :m] = step >> 1
            for k in range(langs):
                phrases[k] += np.bincount(owner[lo:hi], count[k], minlength=n).astype(np.int64)
            lo = hi
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(sizes[:, None] > 0, phrases.T * np.array(self.weights) / sizes[:, None], np.inf)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def predict(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray]:
        """The language of each text, the first by name of equals, and a score: the second-best entropy's share of the two best."""
        points, at, n_letters = normalised(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        h = self.entropies(points, at)
        best = np.argmin(h, axis=1)
        two = np.sort(h, axis=1)[:, :2]
        with np.errstate(invalid="ignore"):
            score = two[:, 1] / (two[:, 0] + two[:, 1]) if h.shape[1] > 1 else np.ones(len(texts))
        known = n_letters > 0
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, longest: int = LONGEST) -> CrossParser:
    """Tables from a bounded sample of whole texts of each language, outside the held-out fold and with a language."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(lang_col).cast("string").alias("__lang")).where(~held_out("__id"))
    by_language: dict[str, list[str]] = {}
    for lang, _, text in sample_texts(rows, "__lang", sample, longest, "__id", "__text"):
        by_language.setdefault(lang, []).append(text)
    return CrossParser(by_language)


def identify(docs: DataFrame, model: CrossParser, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), hold: bool = True) -> DataFrame:
    """Per document: id, ``keep``, held_out, lang_pred and score (0 to 1; 0.5 if two languages fit alike).

    A null text, or one without letters, is ``und`` with score 0. Whole texts are parsed, long
    ones too; repeated rows each get a row, an empty table an empty result. A null id isn't
    held out. A kept column that is called like a result gives way to it. No shuffle; the
    broadcast tables are bounded by ALL_TRAINING characters. A worker holds them for its next task, or
    without ``hold`` drops them at each task's end.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> dict:
        lang, score = shared.value.predict(texts.to_pylist())
        return {"lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64())}

    found = map_texts(docs, work, "lang_pred string, score double", id_col, text_col, [k for k in keep if k != "held_out"], limit=1 << 20, lent=None if hold else shared)
    return found.select(*[c for c in found.columns if c not in ("lang_pred", "score")], held_out(id_col).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose text has a language, with their own columns, whatever those are called.

    Rejected are those that are ``und``: null texts and texts without letters, and all where nothing can be learnt.
    Ties go to the first language by name; repeated rows are treated alike; an empty table stays empty.
    """
    plain, (i, text, lang) = with_own_names(docs, id_col, text_col, lang_col)
    found = identify(plain, learn(plain, i, text, lang), i, text, keep=plain.columns, hold=False)
    return found.where(F.col("lang_pred") != UNKNOWN).select(*plain.columns).toDF(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by tables from the rows outside the held-out fold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
