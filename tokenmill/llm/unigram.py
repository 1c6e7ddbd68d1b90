"""Token counts of a unigram vocabulary: best segmentation by dynamic programming, counts only.

White space becomes marks, one mark stands before the text. With ``split`` every mark begins a
pre-token, as word-start tokenizers cut; without it a text is one, as a model encodes it, and pieces
may hold runs of marks. An Aho-Corasick automaton lists every vocabulary piece that ends at a
character, longest first, and the program keeps the best sum of scores and its number of pieces per
character. Of equal sums the longest last piece wins, which is the rule of the usual
implementations. A character that no single-character piece covers may stand alone at the least
score minus ten; it counts as its bytes. Scores are the model file's, whatever they mean there.

Texts are cut further only where no piece can reach over, so counts of parts add up exactly, and
equal parts are counted once per worker: before a run of marks, unless a piece has a mark after
another character, and at line feeds, unless a piece has one.
Texts are taken whole; null and empty ones have no tokens. Other columns are kept.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField

from tokenmill.llm.arrays import add_columns, row_pieces, text_bytes

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_WORDS = 500_000  # of a worker; the cache starts anew beyond
CACHED_LENGTH = 64

Vocabulary = tuple[tuple[str, float], ...]


def read_vocabulary(path: str) -> Vocabulary:
    """(piece, score) of the ordinary pieces of a model file."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(
        (model.id_to_piece(i), model.get_score(i))
        for i in range(model.vocab_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    )


class Counter:
    def __init__(self, vocabulary: Vocabulary, split: bool = True):
        self.split = split
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.matches.add_word(piece, (len(piece), score))
        self.matches.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.cut_lines = not any("\n" in piece for piece, _ in vocabulary)
        cut_words = not any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary)
        start, inner = (f"[{MARK}\n]", "\n") if self.cut_lines else (MARK, "")
        rest = f"{MARK}*[^{MARK}{inner}]*" if cut_words else f"[^{inner}]*" if inner else ".*"
        self.parts = re.compile(start + rest, re.S)
        self.cache: dict[str, int] = {}

    def best(self, segment: str) -> tuple[float, int]:
        """(score, tokens) of the best segmentation."""
        ending: list[list[tuple[int, float]]] = [[] for _ in segment]
        if len(self.matches):
            for end, match in self.matches.iter(segment):
                ending[end].append(match)
        scores, counts = [0.0], [0]
        for at, found in enumerate(ending):
            score = count = None
            single = False
            for length, gain in found:
                start = at + 1 - length
                single = single or length == 1
                if score is None or scores[start] + gain > score:
                    score, count = scores[start] + gain, counts[start] + 1
            if not single and (score is None or scores[at] + self.unknown > score):
                score = scores[at] + self.unknown
                count = counts[at] + len(segment[at].encode())
            scores.append(score)
            counts.append(count)
        return scores[-1], counts[-1]

    def _word(self, word: str) -> int:
        if self.cut_lines and word.startswith("\n"):
            return 1 + self.best(word[1:])[1]
        if not self.split:
            return self.best(word)[1]
        return self.best(MARK + word)[1]

    def words(self, text: str) -> list[str]:
        """Parts to count; of pre-tokens without their mark, after a cut with the line feed in its place."""
        if not text:
            return []
        if not self.split:
            text = text.replace(" ", MARK)
            return self.parts.findall(text if text[0] == MARK else MARK + text)
        text = text.replace(MARK, " ")
        text = text[1:] if text[0] == " " else text
        return (text.replace("\n", " \n") if self.cut_lines else text).split(" ")

    def count(self, texts: Sequence[str]) -> list[int]:
        words = list(map(self.words, texts))
        if len(self.cache) > CACHED_WORDS:
            self.cache.clear()
        new = set().union(*words).difference(self.cache)
        for word in new:
            self.cache[word] = self._word(word)
        counts = [sum(map(self.cache.__getitem__, w)) for w in words]
        for word in new:
            if len(word) > CACHED_LENGTH:
                del self.cache[word]
        return counts


@lru_cache(maxsize=2)
def _counter(vocabulary: Vocabulary, split: bool) -> Counter:
    return Counter(vocabulary, split)


def count_tokens(
    df: DataFrame, vocabulary: Vocabulary, text: str = "text", split: bool = True
) -> DataFrame:
    """``df`` with ``n_tokens`` of every text."""

    def kernel(batch: pa.RecordBatch) -> list[pa.Array]:
        counter, column = _counter(vocabulary, split), batch.column(text)
        counts = []
        for lo, hi in row_pieces(text_bytes(column)[1]):
            counts += counter.count([t or "" for t in column.slice(lo, hi - lo).to_pylist()])
        return [pa.array(counts, pa.int64())]

    return add_columns(df, [StructField("n_tokens", LongType())], kernel)
