"""BPE encoding by a tokenization automaton, and decoding by its arc labels (operator 4).

The merges are compiled one by one, in rank order, into a deterministic automaton whose
arcs are tokens and which accepts exactly the token sequences that BPE produces. It starts
as one state with a loop for each base symbol. The gadget of a merge ``u v -> w`` makes a
copy of the state that ``u`` leads to without its ``v`` arc, leads ``u`` there from now on,
and gives each state from which ``u v`` could be walked an arc ``w`` to where ``v`` led.

In this automaton the target of an arc depends on its token only (``target``), and a copy
differs from its original by the one arc taken away. Rows are therefore stored as differences:
an arc ``w`` is present in a state that is older than the merge exactly if its left part is, and
in a younger one exactly if the original has it and it is not the removed one. The copies made
for one token follow each other (``chain``), so a whole stretch of them is passed with one look
into ``gadgets``. That keeps the tables linear in the merges instead of quadratic, and each
walked (state, token) pair is looked up in a memo table after the first time.

A word has one accepting path. It is found from left to right: every prefix has one path of
its own, so a position needs a single (state, token). The tokens that end at a position are those of
the state that a matching automaton (Aho-Corasick) over the bytes of all tokens is in, one step for each byte.
The new words of a piece of texts are walked in order, so that neighbours share their first letters.

Words are split by the normaliser and pattern of the tokenizer file, with Python's Unicode tables. A
text with code points that those don't know yet is split by the tokenizers library itself.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from bisect import bisect_right
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.arrays import map_texts

#: Memoised words, arcs and byte steps of a worker; tables are emptied when they are full, that of words except for the words at hand.
WORD_MEMO, ARC_MEMO, STEP_MEMO = 100_000, 200_000, 200_000

END = "</w>"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class TokenizationAutomaton:
    """The automaton of a BPE vocabulary whose last symbol of a word carries END."""

    def __init__(self, vocab: dict[str, int], merges: Sequence[Sequence[str]]):
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        self.labels: dict[int, str] = {i: t for t, i in vocab.items()}
        size = max(vocab.values()) + 1
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        for token, i in vocab.items():
            ends = token.endswith(END) and len(token) > len(END)
            stem = token[: -len(END)] if ends else token
            if all(c in byte_of for c in stem):
                (self.final if ends else self.inner)[bytes(byte_of[c] for c in stem)] = i
        self.born_token = [0] * size
        self.left = [-1] * size
        self.dead = [False] * size
        self.target = [0] * size
        #: By state: when it was made, and for which token.
        self.born, self.owner = [0], [-1]
        #: By token: the states made for it and their times, and where it led before the first of them.
        self.chain: list[list[int]] = [[] for _ in range(size)]
        self.base = [0] * size
        self.gadgets: dict[int, int] = {}
        self.arcs: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges, 1):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.led = [t << 20 for t in self.target]
        self._matching()
        self.raw = {i: i.to_bytes(4, "little") for i in self.labels}
        self.words: dict[str | tuple[str], tuple[bytes, str]] = {}
        #: The word walked last, and by position its states in either automaton, the first ones shifted, and its tokens.
        self.walked: tuple[bytes, list[int], list[int], list[tuple[int, int]]] = (b"", [0], [0], [(0, -1)])

    def _matching(self) -> None:
        """Builds the matching automaton: a state is a beginning of tokens, the longest that the bytes so far end with."""
        #: state << 8 | byte -> longer state; steps that fall back to shorter beginnings are found by ``fails`` and memoised.
        self.longer: dict[int, int] = {}
        self.steps: dict[int, int] = {}
        came, depth = [(0, 0)], [0]
        own: dict[int, list[tuple[int, int] | None]] = {}
        for k, tokens in enumerate((self.inner, self.final)):
            for stem, i in tokens.items():
                state = 0
                for b in stem:
                    to = self.longer.get(state << 8 | b)
                    if to is None:
                        to = self.longer[state << 8 | b] = len(came)
                        came.append((state, b))
                        depth.append(depth[state] + 1)
                    state = to
                own.setdefault(state, [None, None])[k] = (len(stem), i)
        self.fails = [0] * len(came)
        #: By state the (length, token) that end there, longest first: inside a word, and at its end.
        self.ending: list[tuple[tuple[int, int], ...]] = [()] * len(came)
        self.ending_last = list(self.ending)
        for state in sorted(range(1, len(came)), key=depth.__getitem__):
            before, b = came[state]
            shorter = self.fails[state] = self._step(self.fails[before], b) if before else 0
            for k, table in enumerate((self.ending, self.ending_last)):
                one = own[state][k] if state in own else None
                table[state] = (one, *table[shorter]) if one else table[shorter]

    def _step(self, state: int, byte: int) -> int:
        """Where a byte leads, by ever shorter beginnings."""
        while True:
            to = self.longer.get(state << 8 | byte)
            if to is not None:
                return to
            if not state:
                return 0
            state = self.fails[state]

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        self.born_token[w], self.left[w], self.dead[w] = time, u, not self._walk(self.target[u], v)
        self.target[w] = self.base[w] = self.target[v]
        # one state for each merge, so a state's number is its time
        self.born.append(time)
        self.owner.append(u)
        self.chain[u].append(time)
        self.gadgets[u << 20 | v] = time
        self.target[u] = time

    def _walk(self, state: int, token: int) -> bool:
        """Whether a state has a token's arc, from the differences."""
        while True:
            if self.dead[token]:
                return False
            time = self.born_token[token]
            if self.born[state] > time:
                u = self.owner[state]
                if self.gadgets.get(u << 20 | token, state + 1) <= state:
                    return False
                older = bisect_right(self.chain[u], time)
                state = self.chain[u][older - 1] if older else self.base[u]
            elif self.left[token] < 0:
                return True
            else:
                token = self.left[token]

    def has_arc(self, state: int, token: int) -> bool:
        key = state << 20 | token
        known = self.arcs.get(key)
        if known is None:
            if len(self.arcs) >= ARC_MEMO:
                self.arcs.clear()
            known = self.arcs[key] = self._walk(state, token)
        return known

    def encode_word(self, word: bytes) -> list[int]:
        """The tokens of the one accepting path of a pre-split word; what it shares with the word before it is walked once."""
        n, led, steps, arcs = len(word), self.led, self.steps, self.arcs
        before, matches, states, came = self.walked
        shared, most = 0, min(len(before), n) - 1
        while shared < most and before[shared] == word[shared]:
            shared += 1
        matches, states, came = matches[: shared + 1], states[: shared + 1], came[: shared + 1]
        at, end, ending = matches[shared], shared, self.ending
        for byte in word[shared:]:
            end += 1
            key = at << 8 | byte
            at = steps.get(key)
            if at is None:
                if len(steps) >= STEP_MEMO:
                    steps.clear()
                at = steps[key] = self._step(key >> 8, byte)
            for found in self.ending_last[at] if end == n else ending[at]:
                size, token = found
                key = states[end - size] | token
                known = arcs.get(key)
                if known is None:
                    known = self.has_arc(key >> 20, token)
                if known:
                    matches.append(at)
                    states.append(led[token])
                    came.append(found)
                    break
            else:
                raise ValueError("the vocabulary has no symbol for a byte of the word")
        self.walked = word, matches, states, came
        path = []
        while n:
            size, token = came[n]
            n -= size
            path.append(token)
        return path[::-1]

    def word(self, word: str) -> tuple[bytes, str]:
        """The ids as little-endian 32-bit integers, and the labels of their arcs, memoised."""
        ids, raw, labels = self.encode_word(word.encode()), self.raw, self.labels
        return b"".join([raw[i] for i in ids]), " ".join([labels[i] for i in ids])

    def decode(self, ids: Sequence[int]) -> str:
        """The labels of the arcs, with a space between; an id that isn't in the vocabulary has none."""
        labels = self.labels
        return " ".join(labels[i] for i in ids if i in labels)


def unknown_points() -> regex.Pattern:
    """Finds code points that Python's Unicode tables have no category for, so other tables may call them letters."""
    ranges: list[list[int]] = []
    for i in range(0x110000):
        if unicodedata.category(chr(i)) == "Cn":
            if ranges and ranges[-1][1] == i - 1:
                ranges[-1][1] = i
            else:
                ranges.append([i, i])
    return regex.compile("[" + "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges) + "]")


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordBpe:
    """A tokenizer file of this kind: normaliser, splitter and automaton; special tokens stand for themselves."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = TokenizationAutomaton(spec["model"]["vocab"], spec["model"]["merges"])
        self.automaton.labels |= {i: t for t, i in specials.items()}
        self.specials = {t: (i.to_bytes(4, "little"), t) for t, i in specials.items()}
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.rules = json.dumps({k: spec[k] for k in ("normalizer", "pre_tokenizer")})
        self._compile(split)

    def _compile(self, split: str) -> None:
        self.split = split
        self.marks = sorted({t[0] for t in self.specials})
        self.unknown = self.library = None
        self.find = regex.compile(split).findall
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) or r"(?!)")

    def __getstate__(self) -> dict:
        return {"automaton": self.automaton, "specials": self.specials, "split": self.split, "rules": self.rules}

    def __setstate__(self, state: dict) -> None:
        self.automaton, self.specials, self.rules = state["automaton"], state["specials"], state["rules"]
        self._compile(state["split"])

    def words(self, text: str) -> list[str]:
        """Pre-split words of a text without special tokens: NFC, white space as one space, each character in lower case."""
        if not text.isascii():
            if not _latin(text):
                self.unknown = self.unknown or unknown_points()
                if self.unknown.search(text):
                    return self._library_words(text)
            text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # by characters, so a last sigma is like any other
        return self.find(text.lower())

    def _library_words(self, text: str) -> list[str]:
        """The same words, by the library's normaliser and its split."""
        if self.library is None:
            from tokenizers import Tokenizer

            rules = json.loads(self.rules)
            rules["pre_tokenizer"] = rules["pre_tokenizer"]["pretokenizers"][0]
            whole = {"version": "1.0", "added_tokens": [], "model": {"type": "BPE", "vocab": {}, "merges": []}, **rules}
            self.library = Tokenizer.from_str(json.dumps(whole))
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def split_text(self, text: str) -> list[str | tuple[str]]:
        """The words of a text, and its special tokens as tuples of one."""
        if not any(c in text for c in self.marks):
            return self.words(text)
        keys, at = [], 0
        for m in self.cut.finditer(text):
            keys += self.words(text[at : m.start()])
            keys.append((m[0],))
            at = m.end()
        return keys + self.words(text[at:])

    def encode_texts(self, texts: Sequence[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as bytes, and its labels with a space between; words that are new to the memo are walked once, for all texts."""
        memo, word = self.automaton.words, self.automaton.word
        split = [self.split_text(t) for t in texts]
        new = set().union(*split)
        if len(memo) + len(new - memo.keys()) > WORD_MEMO:
            own = {w: memo[w] for w in new if w in memo}
            memo.clear()
            memo.update(own)
        new -= memo.keys()
        special = [w for w in new if type(w) is tuple]
        memo.update((w, self.specials[w[0]]) for w in special)
        new.difference_update(special)
        for w in sorted(new):  # neighbours share their first letters
            memo[w] = word(w)
        out = []
        for words in split:
            parts = [memo[w] for w in words]
            out.append((b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts])))
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        raw = self.encode_texts([text])[0][0]
        return list(memoryview(raw).cast("I")) if raw else []

    def decode(self, ids: Sequence[int]) -> str:
        """The text of the ids: labels with a space between, special tokens included."""
        return self.automaton.decode(ids)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False, hold: bool = True) -> DataFrame:
    """Each text encoded and decoded: id, n_tokens, ids_sha256, decoded_sha256, and with ``ids`` the ids and the decoded text.

    Null is the empty text, which has no tokens and decodes to ''. One output row for each
    input row, repeated rows and ids included; an empty table gives an empty result. Long
    texts are handled alone, in memory in proportion to their length. No shuffle: the
    automaton (linear in the vocabulary, so bounded) is broadcast, the rest is one map. A worker
    holds the automaton and its memos for its next task, or without ``hold`` drops them at each task's end.
    """
    shared = spark.sparkContext.broadcast(WordBpe(path or default_path()))

    def work(texts: pa.Array) -> dict:
        bpe = shared.value
        n, id_hash, text_hash, raws, decoded_texts = [], [], [], [], []
        for raw, decoded in bpe.encode_texts(texts.to_pylist()):
            n.append(len(raw) // 4)
            id_hash.append(hashlib.sha256(raw).hexdigest())
            text_hash.append(hashlib.sha256(decoded.encode()).hexdigest())
            if ids:
                raws.append(raw)
                decoded_texts.append(decoded)
        out = {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(id_hash, pa.string()), "decoded_sha256": pa.array(text_hash, pa.string())}
        if ids:  # the ids' bytes are the array's buffer
            at = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            flat = pa.Array.from_buffers(pa.int32(), sum(n), [None, pa.py_buffer(b"".join(raws))])
            out |= {"ids": pa.ListArray.from_arrays(at, flat), "decoded": pa.array(decoded_texts, pa.string())}
        return out

    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return map_texts(docs, work, fields + (", ids array<int>, decoded string" if ids else ""), id_col, text_col, limit=1 << 20, lent=None if hold else shared)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return encode_documents(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
