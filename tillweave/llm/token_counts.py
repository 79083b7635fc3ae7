"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming over the
characters carries the best score and the number of pieces of it, and no pieces. The rules are those of the
unigram tokenizers in public use: text is cut before each blank, blanks become a marker, a character that
no single piece covers costs a fixed penalty and falls back to its bytes, neighbours of that kind count as one
run, and of paths with equal scores the one whose last piece starts first stays.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillweave.llm.common import map_batches

#: Stands for a blank, and before the first word.
MARK = "▁"
#: What an unknown character scores below the lowest piece.
UNKNOWN_PENALTY = 10.0
VOCABULARY_PATH = "/opt/tokenizers/piece_bpe_32k.model"
#: Words a task remembers.
CACHE_WORDS = 300_000


def load_pieces(path: str = VOCABULARY_PATH) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, in id order."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Pieces of a word that begins with the marker; a bounded cache of words seen."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        super().__init__()
        self.scores: dict[str, float] = {}
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece and piece not in self.scores:
                self.automaton.add_word(piece, (len(piece), score))
            self.scores.setdefault(piece, score)
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in pieces) - UNKNOWN_PENALTY
        self.bytes_known = all(f"<0x{b:02X}>" in self.scores for b in range(256))

    def count(self, word: str) -> int:
        """Best score first, then, as paths are met by their start, the earliest start of the last piece.

        The automaton gives matches by their end, of one end the longest first, which is the earliest start.
        """
        best, pieces, running = [0.0], [0], [False]
        matches = self.automaton.iter(word)
        end, found = next(matches, (-1, None))
        for at in range(len(word)):
            single, top, count, run = False, None, 0, False
            while end == at:
                length, score = found
                start = at + 1 - length
                total = best[start] + score
                if top is None or total > top:
                    top, count = total, pieces[start] + 1
                if length == 1:
                    single = True
                end, found = next(matches, (-1, None))
            if not single:
                total = best[at] + self.unknown
                if top is None or total > top:
                    # A run of unknown characters is one piece, unless its bytes are pieces.
                    size = len(word[at].encode()) if self.bytes_known else 0 if running[at] else 1
                    top, count, run = total, pieces[at] + size, True
            best.append(top)
            pieces.append(count)
            running.append(run)
        return pieces[-1]

    def __missing__(self, word: str) -> int:
        found = self.count(MARK + word)
        if len(self) > CACHE_WORDS:  # only a cache: bounded, and made anew
            self.clear()
        if len(word) < 200:
            self[word] = found
        return found

    def text(self, text: str | None) -> int:
        """Pieces of a text; each blank begins a word, so a run of blanks is a row of lone markers."""
        if not text:
            return 0
        body = text.replace(MARK, " ")
        return sum(map(self.__getitem__, (body[1:] if body[0] == " " else body).split(" ")))


def _count(pieces: list[tuple[str, float]]):
    counter = Counter(pieces)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts = [counter.text(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "n_tokens"])

    return work


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens): one row per input row.

    Null and empty texts have 0 tokens. Repeated rows get equal counts; an empty table gives no rows. Other columns are
    not read. ``pieces`` goes to every task: its size is that of the vocabulary.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    make: Callable = lambda: _count(shared.value)
    return map_batches(rows, make, f"id {kind}, n_tokens bigint").withColumnRenamed("id", id_col)
