"""Token counts under a unigram vocabulary, by Viterbi without segmentations.

The tokenizer is that of the ``tokenizers`` library with a Unigram model and Metaspace
pre-tokenisation: each space of the whole text becomes the word mark, one is put in front
unless the text begins with it, and a word runs from one mark to the next.  Line breaks, tabs
and other characters belong to words.

For each word an Aho-Corasick automaton lists the vocabulary pieces that end at each
position; dynamic programming carries, per position, the best score and the number of tokens
on the best path, and no back pointers.  Ties are broken as the library breaks them: at
each end the candidate with the earliest start wins unless a later one scores strictly more.
A character that no one-character piece covers may be unknown, at ten below the least score;
neighbouring unknown characters are one token, or their bytes where the vocabulary has all
byte pieces.  A word's count doesn't depend on its neighbours, so each distinct word is
counted once per worker.

Defined results: null and empty texts have no tokens; a text of n spaces has the tokens of n
marks; whole texts of any length are counted, in time linear in them; repeated rows are rows of
their own; an empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECES = "piece_bpe_32k.model"
WORD_MARK = "▁"
#: Distinct words that a worker remembers.
REMEMBERED = 500_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id, from a sentencepiece model."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), float(sp.get_score(i))) for i in range(sp.get_piece_size())]


class Counter(dict):
    """Tokens of words; ``counter[word]`` computes and remembers what is new.  A word is given without its mark."""

    def __init__(self, vocab: list[tuple[str, float]], unknown: str = "<unk>", byte_fallback: bool = True, limit: int = REMEMBERED):
        import ahocorasick

        self.limit, self.automaton, scores = limit, ahocorasick.Automaton(), {}
        for piece, score in vocab:
            scores[piece] = score
        self.single = {p for p in scores if len(p) == 1}
        for piece, score in scores.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = min(scores.values()) - 10
        self.bytes = byte_fallback and all(f"<0x{b:02X}>" in scores for b in range(256))
        # Where no piece has a line break, every path stops before and after it.  With whole scores sums
        # are exact, so what is between breaks can be counted, and remembered, on its own.
        self.breaks = self.bytes and not any("\n" in p for p in scores) and all(float(x).is_integer() for x in scores.values())
        self.tails: dict[str, int] = {}

    def viterbi(self, text: str) -> tuple[float, int]:
        """(score, tokens) of the best path over ``text``."""
        best, count, in_unknown = [0.0], [0], [False]
        found = self.automaton.iter(text)  # by end, longest first, so earliest start first
        last, match = next(found, (-1, None))
        for start, char in enumerate(text):
            top, tokens, unknown = None, 0, False
            while last == start:
                at = start + 1 - match[0]
                total = best[at] + match[1]
                if top is None or total > top:
                    top, tokens = total, count[at] + 1
                last, match = next(found, (-1, None))
            if char not in self.single:
                total = best[start] + self.unknown_score
                if top is None or total > top:
                    top, unknown = total, True
                    tokens = count[start] + (len(char.encode()) if self.bytes else 0 if in_unknown[start] else 1)
            best.append(top)
            count.append(tokens)
            in_unknown.append(unknown)
        return best[-1], count[-1]

    def _tail(self, part: str) -> int:
        """Tokens of what follows a line break within a word."""
        tokens = self.tails.get(part)
        if tokens is None:
            tokens = self.viterbi(part)[1]
            if len(part) <= 64:
                if len(self.tails) >= self.limit:
                    self.tails.clear()
                self.tails[part] = tokens
        return tokens

    def __missing__(self, word: str) -> int:
        if self.breaks and "\n" in word:
            head, *rest = word.split("\n")
            return self[head] + len(rest) + sum(map(self._tail, rest))
        tokens = self.viterbi(WORD_MARK + word)[1]
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = tokens
        return tokens

    @staticmethod
    def words(text: str | None) -> list[str]:
        """The words of a whole text, each without the mark in front of it."""
        if not text:
            return []
        marked = text.replace(" ", WORD_MARK)
        return (marked[1:] if marked[0] == WORD_MARK else marked).split(WORD_MARK)

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        return sum(map(self.__getitem__, self.words(text)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of this worker process."""
    return Counter(vocabulary(path))


def token_counts(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row."""
    path = path or public_tokenizers.path(PIECES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for b in batches:
            words = [tokens.words(t.as_py()) for t in b.column(1)]
            counts = [pa.array([len(w) for w in words], pa.int64()), pa.array([sum(map(tokens.__getitem__, w)) for w in words], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts], names=["doc_id", "n_words", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")


def op5_viterbi_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
