"""Token counts by unigram forward scores over a trie of pre-tokens (operator 10).

The distinct pre-tokens of a piece of the corpus are inserted in a trie. A new node's forward
score, the best sum of piece scores that spells the path to it, follows from the nodes above
it, so it is computed once for all pre-tokens that share the prefix. A node keeps the number
of tokens of its best segmentation; at the ends of pre-tokens these are the counts, and a
text's count is their sum over its pre-tokens.

The vocabulary's file orders its pieces by rank and has no probabilities, so the score of the
piece of rank r is that of a Zipf law, -ln(r + ZIPF_SHIFT). Characters that aren't a piece fall
back to one token for each of their bytes. Of equal sums the one with fewer tokens is taken,
then the one whose last token is longer.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corvane.llm.arrays import codes_of, map_texts, space_words, sums

ZIPF_SHIFT = 2.7
#: Nodes of a worker's trie; a full one is emptied between two pieces of the corpus.
NODES = 500_000
SPACE = "▁"


class UnigramTrie:
    """Forward scores and token counts by node; node 0 is the empty prefix."""

    def __init__(self, pieces: Sequence[str]):
        self.scores = {p: -math.log(r + ZIPF_SHIFT) for r, p in reversed(list(enumerate(pieces)))}
        self.byte_score = -math.log(len(pieces) + ZIPF_SHIFT)
        self.longest = max(map(len, pieces), default=1)
        self.clear()

    def clear(self) -> None:
        self.children: dict[int, int] = {}
        self.best, self.counts = [0.0], [0]

    def __getstate__(self) -> dict:
        return {"scores": self.scores, "byte_score": self.byte_score, "longest": self.longest}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def insert(self, word: str) -> int:
        """The node of a pre-token; nodes that are new get their forward score and count."""
        children, best, counts, scores = self.children, self.best, self.counts, self.scores
        node, path = 0, [0]
        for end, c in enumerate(word, 1):
            key = node << 21 | ord(c)
            node = children.get(key, 0)
            if not node:
                n_bytes = len(c.encode("utf-8", "surrogatepass"))
                top, count = (best[path[-1]] + self.byte_score * n_bytes, counts[path[-1]] + n_bytes) if c not in scores else (-math.inf, 0)
                for start in range(max(0, end - self.longest), end):
                    score = scores.get(word[start:end])
                    if score is not None:
                        before = path[start]
                        score += best[before]
                        if score > top or score == top and counts[before] + 1 < count:
                            top, count = score, counts[before] + 1
                node = children[key] = len(best)
                best.append(top)
                counts.append(count)
            path.append(node)
        return node


def default_pieces() -> list[str]:
    """The normal pieces of the public 32k vocabulary, by rank."""
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    normal = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return [sp.id_to_piece(i) for i in sorted(normal, key=lambda i: (-sp.get_score(i), i))]


def count_tokens(spark: SparkSession, docs: DataFrame, pieces: Sequence[str] | None = None, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Per document: id, ``keep``, n_words (pre-tokens ``[^\\x20\\x09-\\x0D]+``), n_tokens and log_score (the sum of their best scores, to 6 places).

    Each pre-token is spelt with a leading U+2581. Null and empty texts have 0 of all.
    Repeated rows each get a row, an empty table an empty result; a kept column that is called
    like a result gives way to it. No shuffle; the broadcast vocabulary is bounded and a
    worker's trie by NODES and one piece of the corpus.
    """
    shared = spark.sparkContext.broadcast(UnigramTrie(default_pieces() if pieces is None else pieces))

    def work(texts: pa.Array) -> dict:
        trie = shared.value
        if len(trie.best) > NODES:
            trie.clear()
        offsets, words = space_words(texts)
        code, known = codes_of(words)
        at = np.fromiter((trie.insert(SPACE + w) for w in known.to_pylist()), np.int64, len(known))
        counts, best = np.array(trie.counts, np.int64), np.array(trie.best)
        own = best[at[code]]
        score = np.fromiter((own[a:b].sum() for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.float64, len(texts))
        return {"n_words": np.diff(offsets), "n_tokens": sums(counts[at[code]], offsets), "log_score": np.round(score, 6) + 0.0}

    return map_texts(docs, work, "n_words long, n_tokens long, log_score double", id_col, text_col, keep)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, by the public 32k vocabulary."""
    return count_tokens(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
