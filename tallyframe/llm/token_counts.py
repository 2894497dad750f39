"""Token counts of a unigram tokenizer without its pieces: count-only Viterbi over vocabulary matches."""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame, functions as F

#: The tokenizers' sign for a blank, and what an unknown character costs below the lowest score.
BLANK, UNKNOWN = "▁", 10.0


class UnigramCounter:
    """Number of tokens of the best segmentation of a text under a unigram vocabulary.

    An Aho-Corasick automaton enumerates all vocabulary matches by where they end. For each place the best
    score and the number of pieces that lead there are kept, nothing else. Ties go as in the tokenizer: a
    later candidate replaces an earlier one only if its score is greater, candidates being
    seen from the earliest start on, so of equal ones the longest last piece wins. A character that no
    one-character piece covers is also a candidate, at the lowest score less UNKNOWN; it counts one
    token for each UTF-8 byte if the vocabulary has all byte pieces, else one token for each run of such characters.

    If no piece has a blank after another sign, no piece crosses the start of a word. If besides all scores are whole numbers,
    sums of them are exact wherever they start, so ties between a word's segmentations do not depend on what comes before: a text's
    count is then the sum over its words, which are counted once and kept (``room`` words). With any other score the
    tokenizer's running sum rounds differently in each place, so the whole text is segmented with one running sum.
    """

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, room: int = 400_000):
        self.automaton, self.byte_fallback, self.room = ahocorasick.Automaton(), byte_fallback, room
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN
        self.largest = max(abs(s) for s in (*(s for _, s in pieces), self.unknown))
        self.by_word = byte_fallback and not any(BLANK in p.lstrip(BLANK) for p, _ in pieces) and all(float(s).is_integer() for _, s in pieces)
        self.kept: dict[str, int] = {}

    def segment(self, text: str) -> int:
        n = len(text)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        fused = [False] * (n + 1)  # the last piece is an unknown character
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, (length, score) in self.automaton.iter(text):
            found[last + 1].append((length, score))
        for end in range(1, n + 1):
            top, pieces, unknown, single = None, 0, False, False
            for length, score in sorted(found[end], reverse=True):
                single = single or length == 1
                if best[end - length] is not None and (top is None or best[end - length] + score > top):
                    top, pieces = best[end - length] + score, count[end - length] + 1
            if not single and best[end - 1] is not None and (top is None or best[end - 1] + self.unknown > top):
                top, unknown = best[end - 1] + self.unknown, True
                pieces = count[end - 1] + (len(text[end - 1].encode("utf-8", "replace")) if self.byte_fallback else int(not fused[end - 1]))
            best[end], count[end], fused[end] = top, pieces, unknown
        return count[n]

    def count(self, text: str) -> int:
        """Tokens of a whole text, a blank put before it; none for an empty text."""
        if not text:
            return 0
        marked = BLANK + text.replace(" ", BLANK)
        if not self.by_word or self.largest * len(marked) >= 2**53:
            return self.segment(marked)
        total, kept = 0, self.kept
        for word in _WORDS.findall(marked):
            n = kept.get(word)
            if n is None:
                n = self.segment(word)
                if len(kept) >= self.room:
                    kept.clear()
                if len(word) <= 64:
                    kept[word] = n
            total += n
        return total


_WORDS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def vocabulary(model_file: str) -> tuple[list[tuple[str, float]], bool]:
    """Pieces with scores of a SentencePiece file, and whether it has byte pieces. Control, unknown and byte pieces match no text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_file)
    every = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in every if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))], any(model.is_byte(i) for i in every)


@lru_cache(maxsize=2)
def counter(model_file: str) -> UnigramCounter:
    """One a Python worker, kept from task to task."""
    return UnigramCounter(*vocabulary(model_file))


def token_counts(docs: DataFrame, model_file: str, text_col: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with ``name``: tokens of each whole text under the unigram reading of the vocabulary file.

    The file's pieces and scores are read as a unigram model, whatever it was made as. Null and empty texts have no
    tokens. A column of that name is replaced; all other columns and all rows, repeated ones too, stay. An empty table stays empty.
    """

    @F.pandas_udf("long")
    def count(texts):
        import pandas as pd

        own = counter(model_file)
        return pd.Series([own.count(t or "") for t in texts], dtype="int64")

    return docs.withColumn(name, count(F.col(text_col)))
