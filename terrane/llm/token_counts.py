"""Token counts by count-only Viterbi.

An Aho-Corasick automaton over a unigram vocabulary lists every piece that ends at each
character; dynamic programming carries only the best score, its piece count and whether the
last piece is unknown. No pieces are built.

Tie rules are those of the unigram tokenizer: of equal scores the path whose last piece is
longest wins; a character that starts no single-character piece may be an unknown of score
(least score - 10); a run of unknowns is one piece, or with byte fallback as many pieces as it
has UTF-8 bytes. Spaces become U+2581 and one stands before the text.

No piece of most vocabularies has U+2581 after another character, so every path breaks before
a run of U+2581 that follows one, and words are counted one by one, with a bounded cache; for
other vocabularies the whole text is one run.

The vocabulary is read from a SentencePiece model file named by a parameter: its pieces with
their scores are used as a unigram vocabulary.

Defined cases: null or empty text has 0 tokens; any length is handled, in time linear in the
text; repeated rows get one result each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Vocabulary:
    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True


def load_vocabulary(path: str = DEFAULT_VOCABULARY) -> Vocabulary:
    """Ordinary pieces and scores of a SentencePiece model; control, unknown, unused and byte pieces match no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    bad = (model.is_control, model.is_unknown, model.is_unused, model.is_byte)
    ids = [k for k in range(model.get_piece_size()) if not any(f(k) for f in bad)]
    return Vocabulary(tuple((model.id_to_piece(k), model.get_score(k)) for k in ids), any(model.is_byte(k) for k in range(model.get_piece_size())))


class Counter:
    """Counts tokens of texts. Words of at most max_cached_chars are remembered, up to max_cached of them."""

    def __init__(self, vocabulary: Vocabulary, max_cached: int = 300_000, max_cached_chars: int = 64):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.bytes = vocabulary.byte_fallback
        self.by_word = not any(SPACE in p.lstrip(SPACE) for p, _ in vocabulary.pieces)
        self.cache, self.max_cached, self.max_chars = {}, max_cached, max_cached_chars

    def run(self, text: str) -> int:
        """Tokens of a run of characters, without cutting it."""
        n = len(text)
        none = float("-inf")
        score, count, open_ = [none] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, piece in self.automaton.iter(text):
            ends[end].append(piece)
        for end in range(n):
            best, start, unknown = none, 0, False
            for length, s in sorted(ends[end], reverse=True):
                x = score[end + 1 - length] + s
                if x > best:
                    best, start, unknown = x, end + 1 - length, False
            if text[end] not in self.single and (x := score[end] + self.unknown) > best:
                best, start, unknown = x, end, True
            score[end + 1] = best
            if not unknown:
                count[end + 1] = count[start] + 1
            elif self.bytes:
                count[end + 1] = count[start] + len(text[end].encode("utf-8", "surrogatepass"))
            else:
                count[end + 1] = count[start] + (not open_[start])
            open_[end + 1] = unknown
        return count[n]

    def word(self, word: str) -> int:
        """Tokens of U+2581 and a word."""
        n = self.cache.get(word)
        if n is None:
            n = self.run(SPACE + word)
            if len(word) <= self.max_chars:
                if len(self.cache) >= self.max_cached:
                    self.cache.clear()
                self.cache[word] = n
        return n

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.by_word or SPACE in text:
            return self.run(SPACE + text.replace(" ", SPACE)) if not self.by_word else self._mixed(text)
        words = text.split(" ")
        if "" not in words:
            cache = self.cache
            return sum([cache[w] if w in cache else self.word(w) for w in words])
        return self._mixed(text)

    def _mixed(self, text: str) -> int:
        """Texts with several spaces in a row, or with U+2581 of their own: each run of them goes with the characters after it."""
        total, at, whole = 0, 0, SPACE + text.replace(" ", SPACE)
        while at < len(whole):
            end = at
            while end < len(whole) and whole[end] == SPACE:
                end += 1
            close = whole.find(SPACE, end)
            close = len(whole) if close < 0 else close
            total += self.word(whole[at + 1 : close]) if end - at == 1 else self.run(whole[at:close])
            at = close
        return total


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Per row of docs: doc_id, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for b in batches:
            counts = [counter.text(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long")
