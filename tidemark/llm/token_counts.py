"""Token counts of a unigram tokenizer without its tokens: Viterbi that carries a best score and a count.

A text is cut before every space, which becomes the word mark; words are independent, so each distinct one is counted
once and lately used ones are kept. An Aho-Corasick automaton lists all vocabulary pieces that end at each character;
dynamic programming over the characters keeps, for the best way to each place, its score and number of pieces.

Tie rule of the tokenizer: of equal scores the piece that begins first (the longest) wins; sums are double precision
in text order. A character no piece of one character covers may be unknown, at ten below the lowest piece score.
Unknown characters count as their bytes where the vocabulary has byte pieces, otherwise a run of them counts once.
The vocabulary file is a parameter, read by each worker.

Defined results: null and empty texts have no tokens. Rows are counted one by one; whole texts, of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from tidemark.llm import words

#: Fixed value: the word mark of the vocabulary files.
MARK = "▁"
PENALTY = 10.0
WORDS = 400_000


class Counter:
    """Counts pieces of words under a vocabulary of (piece, score)."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_for_unknown: bool):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - PENALTY
        self.bytes_for_unknown = bytes_for_unknown
        self.kept = words.Recent(self.count_word, WORDS)

    def count_word(self, word: str) -> int:
        """Pieces of the best cut of ``MARK`` + ``word``."""
        text = MARK + word
        n = len(text)
        found: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for last, piece in self.automaton.iter(text):
            found[last + 1].append(piece)
        best, count, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for end in range(1, n + 1):
            top, begin, single = None, -1, False
            for length, score in found[end]:
                single = single or length == 1
                value = score + best[end - length]
                if top is None or value > top or (value == top and end - length < begin):
                    top, begin = value, end - length
            if not single:
                value = self.unknown + best[end - 1]
                if top is None or value > top:
                    top, unknown[end] = value, True
            best[end] = top
            if not unknown[end]:
                count[end] = count[begin] + 1
            elif self.bytes_for_unknown:
                count[end] = count[end - 1] + len(text[end - 1].encode())
            else:
                count[end] = count[end - 1] + (not unknown[end - 1])
        return count[n]

    def count(self, text: str) -> int:
        if not text:
            return 0
        parts = text.replace(" ", MARK).split(MARK)
        # a text that begins with a space has its mark already
        return sum(map(self.kept.__getitem__, parts if parts[0] else parts[1:]))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of a model file with pieces and scores, one per worker."""
    if path not in _COUNTERS:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        pieces = [(model.id_to_piece(k), model.get_score(k)) for k in ids
                  if not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k) or model.is_byte(k))]
        _COUNTERS.clear()
        _COUNTERS[path] = Counter(pieces, any(model.is_byte(k) for k in ids))
    return _COUNTERS[path]


def counted(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n = [own.count(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    return made.mapInArrow(run, f"doc_id {kind}, n_tokens bigint")
