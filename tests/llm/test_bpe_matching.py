"""The matching automaton of operator 4: one step for each byte, all tokens that end at a place, and words walked once."""

import random

import pytest

from corvane.llm import bpe_automaton


class Counted(bytes):
    """Bytes that count how many of them are read."""

    reads = 0

    def __getitem__(self, key):
        out = super().__getitem__(key)
        self.reads += len(out) if isinstance(key, slice) else 1
        return out

    def __iter__(self):
        self.reads += len(self)
        return super().__iter__()


@pytest.fixture(scope="module")
def bpe():
    return bpe_automaton.WordBpe(bpe_automaton.default_path())


def test_a_byte_takes_one_step(bpe):
    for text in ("a" * 500, "internationalisation" * 20, "日本語" * 60):
        word = Counted(text.encode())
        assert bpe.automaton.encode_word(word)
        assert word.reads <= 2 * len(word)  # compared with the word before, then stepped over


def test_tokens_that_end_at_a_place(bpe):
    own, rng = bpe.automaton, random.Random(1)
    for word in ["".join(rng.choices("aeinrst", k=14)).encode() for _ in range(200)] + ["größeé日本".encode(), b"!!!???...", bytes(range(200, 256))]:
        at = 0
        for end, byte in enumerate(word, 1):
            at = own._step(at, byte)
            for table, tokens in ((own.ending, own.inner), (own.ending_last, own.final)):
                assert list(table[at]) == [(end - k, tokens[word[k:end]]) for k in range(end) if word[k:end] in tokens]


def test_full_tables_change_nothing(bpe, monkeypatch):
    texts = ["Some words, some MORE words and words again<|endoftext|>", "", "words again and some others<|startoftext|>", "ünïcödé words 12³"]
    want = [bpe.encode(t) for t in texts]
    for name in ("WORD_MEMO", "ARC_MEMO", "STEP_MEMO"):
        monkeypatch.setattr(bpe_automaton, name, 1)
    own = bpe_automaton.WordBpe(bpe_automaton.default_path())
    assert [own.encode(t) for t in texts] == want


def test_words_of_a_piece_are_walked_once(monkeypatch):
    monkeypatch.setattr(bpe_automaton, "WORD_MEMO", 0)
    own, walked = bpe_automaton.WordBpe(bpe_automaton.default_path()), []
    walk = own.automaton.encode_word
    own.automaton.encode_word = lambda word: walked.append(word) or walk(word)
    own.encode_texts(["one two three", "three two four", "one<|endoftext|>four"])
    assert sorted(walked) == [b"four", b"one", b"three", b"two"]
