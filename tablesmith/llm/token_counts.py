"""Operator 9: token counts of a unigram model by dynamic programming over a trie of the distinct pre-tokens.

The pieces are those of a public vocabulary, whose segmentation is used as it is; their log probabilities are estimated
from all documents (:func:`fit`). Tokens are then counted in each pre-token's most probable segmentation.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import small_batches

#: Nodes and terminal counts of a task's trie; a full trie is dropped and begun anew after the text that filled it.
NODES = 1_000_000
#: Distinct pre-tokens that a task of :func:`fit` gathers before it cuts them.
WORDS = 100_000
#: Pre-tokens that are cut in one call.
CUT = 10_000
MARK = "▁"


def fit(docs: DataFrame, model_path: str) -> dict[str, float]:
    """Log probabilities of a public vocabulary's pieces, estimated from all documents (text, ...).

    Each pre-token is cut as the vocabulary's own tokenizer cuts it and its pieces are counted as often as it occurs; a
    score is the logarithm of (count + 1) / (all counts + pieces). Every task adds up its own counts, and the driver
    gets one number a piece. Null and blank texts count nothing; without documents all pieces are equally likely.
    """
    import sentencepiece

    small_batches(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    size = sp.get_piece_size()
    pieces = {i: sp.id_to_piece(i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, words, counts = sentencepiece.SentencePieceProcessor(model_proto=held.value), Counter(), np.zeros(size, np.int64)

        def cut() -> None:
            found = list(words)
            for k in range(0, len(found), CUT):
                part = found[k : k + CUT]
                ids = cutter.encode(part, num_threads=1)
                met = np.fromiter(chain.from_iterable(ids), np.int64)
                np.add.at(counts, met, np.repeat([words[w] for w in part], [len(x) for x in ids]))
            words.clear()

        for batch in batches:
            for text in batch.column(0):
                words.update(word_list(text.as_py()))
                if len(words) > WORDS:
                    cut()
        cut()
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(counts[met], pa.int64())], names=["id", "n"])

    counted = docs.select("text").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = {r["id"]: r["n"] for r in counted.collect() if r["id"] in pieces}  # at most the vocabulary
    total = math.log(sum(counts.values()) + len(pieces))
    return {p: math.log(counts.get(i, 0) + 1) - total for i, p in pieces.items()}


class Trie:
    """Counts tokens of pre-tokens; the forward score of a prefix is computed once, when its node is made.

    The best segmentation has the highest sum of scores, of equal sums the one with the longer last piece. A character
    that no piece covers is one token, with the lowest score less 10.
    """

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - 10
        # pieces from their last character to the first: a character leads to [score or None, the characters before it]
        self.ends: dict = {}
        for piece, score in scores.items():
            here, step = self.ends, [None, None]
            for ch in reversed(piece):
                step = here.setdefault(ch, [None, {}])
                here = step[1]
            step[0] = score
        self.clear()

    def clear(self) -> None:
        # nodes are numbers, 0 the empty prefix: (node, character) -> node, and each node's best score and its tokens
        self.children, self.scores, self.tokens = {}, [0.0], [0]
        self.terminal: dict[str, int] = {}

    def total(self, words: list[str]) -> int:
        """Tokens of all the words of a text; those met before are taken from the terminal counts."""
        for word in set(words).difference(self.terminal):
            self.terminal[word] = self.count(MARK + word)
        n = sum(map(self.terminal.__getitem__, words))
        if len(self.scores) + len(self.terminal) > NODES:
            self.clear()
        return n

    def count(self, word: str) -> int:
        """Tokens of a pre-token. A new node's score comes from the pieces that end at its character, read backwards; way
        has the nodes before each character."""
        node, way, children, scores, tokens = 0, [0], self.children, self.scores, self.tokens
        for k, ch in enumerate(word):
            child = children.get(key := node << 21 | ord(ch))
            if child is None:
                score, before = self.ends.get(ch, (None, None))
                best, first, start = scores[node] + (self.unknown if score is None else score), k, k
                while before and start:
                    start -= 1
                    step = before.get(word[start])
                    if step is None:
                        break
                    score, before = step
                    if score is not None and (s := score + scores[way[start]]) >= best:
                        best, first = s, start
                child = children[key] = len(scores)
                scores.append(best)
                tokens.append(tokens[way[first]] + 1)
            way.append(child)
            node = child
        return tokens[node]


def word_list(text: str | None) -> list[str]:
    """The words between white space; with a leading mark they are the pre-tokens."""
    return text.split() if text else []


def count_tokens(docs: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Adds n_pre_tokens and n_tokens to documents (text, ...), over whole texts, without a shuffle.

    Null, empty and blank texts: 0 and 0. Columns of these names that docs has are replaced; repeated rows are counted
    each.
    """
    docs = docs.drop("n_pre_tokens", "n_tokens")
    small_batches(docs.sparkSession)
    names = list(docs.columns)
    at, held = names.index("text"), docs.sparkSession.sparkContext.broadcast(scores)

    def run(batches):
        trie = Trie(held.value)
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(at):
                found = word_list(text.as_py())
                words.append(len(found))
                tokens.append(trie.total(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*names, "n_pre_tokens", "n_tokens"])

    return docs.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes) + ", n_pre_tokens long, n_tokens long")
