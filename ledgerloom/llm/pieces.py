"""Whole texts as ids of a merge-type sentencepiece model, exactly, and back.

Such a model joins the two neighbours whose joined string is its best piece, the leftmost first, until no two join. A
row of pieces is the result for its text if and only if every two neighbours, merged again on their own, stay as they
are: the first join across a border would also be made in the text of the two pieces alone. So the encoder goes
forward by the longest piece that fits the one before it, takes shorter ones where none goes on, and steps back from
places without any. The pieces before a place are always the same, so a place that failed once has failed for good.

No piece goes on after a space mark inside it, so a text falls into words, and these into parts between letters
and signs that no piece holds together; a worker remembers both.

Null texts count as empty and have no ids. Characters without a piece are the ids of their bytes. Texts of any length
are encoded whole; matches are listed for a stretch of ``WINDOW`` characters at a time. Repeated rows stay, other
columns are not read, and an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgerloom.llm.memory import Memory
from ledgerloom.llm.tokens import vocabulary_path

MODEL = "piece_bpe_32k.model"
SPACE = "▁"  # stands for a space in pieces; texts get one in front
WORDS = 500_000  # remembered words, and half as many parts of words
PAIRS = 1_000_000  # remembered answers for two neighbours
LONGEST_KEY = 64  # characters of what is worth remembering
WINDOW = 1 << 14

_WORD = re.compile(f"{SPACE}({SPACE}*[^{SPACE}]*)")


class PieceEncoder:
    """Pieces are numbered as in the model; a character without a piece counts as one, numbered after them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        self.count = library.get_piece_size()
        if any(library.is_unused(i) for i in range(self.count)):
            raise ValueError("models with unused pieces are split differently")
        self.names = [library.id_to_piece(i) for i in range(self.count)]
        own = [i for i in range(self.count) if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i))]
        self.score = {self.names[i]: library.get_score(i) for i in own}
        self.bytes = {int(self.names[i][3:5], 16): i for i in range(self.count) if library.is_byte(i)}
        self.inside = {self.names[i][k : k + 2] for i in own for k in range(len(self.names[i]) - 1)}  # neighbours that a piece can hold
        reached = [i for i in own if self.merged(self.names[i]) == [self.names[i]]]  # others are never a result
        self.single = {self.names[i]: i for i in reached if len(self.names[i]) == 1}
        self.sizes = [len(name) for name in self.names]
        self.longest = max(self.sizes[i] for i in reached)
        self.automaton = ahocorasick.Automaton()
        for i in reached:
            if self.sizes[i] > 1:
                self.automaton.add_word(self.names[i], i)
        self.automaton.make_automaton()
        held = {c for i in own for c in self.names[i]}
        self.mark = next(c for c in map(chr, range(0xE000, 0xF8FF)) if c not in held)  # no piece reaches across it
        if any(SPACE in name.lstrip(SPACE) for name in self.score):
            raise ValueError("texts do not fall into words in models whose pieces go on after a space mark")
        letters, signs = [c for c in held if c.isalpha()], [c for c in held | {"\n", "\t"} if not c.isalpha() and c != SPACE]
        after, before = {b[1] for b in self.inside if b[0].isalpha()}, {b[0] for b in self.inside if b[1].isalpha()}
        letter, ends, starts = (re.escape("".join(sorted(x))) for x in (letters, set(signs) - after, set(signs) - before))
        # between a letter and a sign that no piece holds together
        self.cut = re.compile(f"(?<=[{letter}])(?=[{ends}])|(?<=[{starts}])(?=[{letter}])")
        self.words, self.parts, self.fits = Memory(WORDS), Memory(WORDS // 2), {}
        self.answers = 0  # in fits

    def merged(self, text: str) -> list[str]:
        """The model's pieces of a short text, by joining one pair after the other."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = score.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found > best):
                    best, at = found, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def name(self, piece: int) -> str:
        return self.names[piece] if piece < self.count else chr(piece - self.count)

    def compatible(self, left: int, right: int) -> bool:
        """Whether two neighbours stay as they are when they are merged again."""
        if left < 0:
            return True
        a, b = self.name(left), self.name(right)
        return a[-1] + b[0] not in self.inside or self.merged(a + b) == [a, b]

    def _matches(self, text: str, begin: int) -> list[list[int]]:
        """For each place of a window, the pieces that start there, shortest first; always one of a single character."""
        end = min(begin + WINDOW, len(text))
        single, after, sizes = self.single, self.count, self.sizes
        found = [[single[c]] if c in single else [after + ord(c)] for c in text[begin:end]]
        for last, piece in self.automaton.iter(text, begin, min(end + self.longest, len(text))):
            start = last - sizes[piece] + 1
            if start < end:
                found[start - begin].append(piece)
        return found

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text."""
        sizes, count, size = self.sizes, self.count, len(text)
        if self.answers > PAIRS:
            self.fits.clear()
            self.answers = 0
        fits = self.fits
        failed, any_failed = bytearray((size >> 3) + 1), False  # a bit for each place
        window, stop, found = 0, min(WINDOW, size), self._matches(text, 0)
        pieces: list[int] = []
        at, left = 0, -1
        options = found[0] if size else []
        while at < size:
            answers = fits.get(left)
            if answers is None:
                answers = fits[left] = {}
            for piece in reversed(options):
                fit = answers.get(piece)
                if fit is None:
                    fit = answers[piece] = self.compatible(left, piece)
                    self.answers += 1
                if fit:
                    end = at + (sizes[piece] if piece < count else 1)
                    if not any_failed or not failed[end >> 3] >> (end & 7) & 1:
                        break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                any_failed = True
                dropped = pieces.pop()
                at -= sizes[dropped] if dropped < count else 1
                left = pieces[-1] if pieces else -1
                if at < window:
                    window = at - at % WINDOW
                    stop, found = min(window + WINDOW, size), self._matches(text, window)
                options = found[at - window]
                options = options[: options.index(dropped)]
                continue
            pieces.append(piece)
            at, left = end, piece
            if at < stop:
                options = found[at - window]
            elif at < size:
                window = at - at % WINDOW
                stop, found = min(window + WINDOW, size), self._matches(text, window)
                options = found[at - window]
        return pieces

    def _with_bytes(self, pieces: list[int]) -> list[int]:
        """Characters without a piece as the pieces of their bytes."""
        if max(pieces) < self.count:
            return pieces
        return [i for piece in pieces for i in ([piece] if piece < self.count else [self.bytes[b] for b in self.name(piece).encode()])]

    def _encoded(self, parts: list[str]) -> list[tuple[int, ...]]:
        """The ids of parts of words, encoded as one text with marks between them."""
        text = self.mark.join(parts)
        if text.count(self.mark) >= len(parts):  # the mark is in a part too
            return [tuple(self._with_bytes(self.backtrack(p))) for p in parts]
        pieces, mark = self.backtrack(text), self.count + ord(self.mark)
        out, begin = [], 0
        for border in [*[i for i, piece in enumerate(pieces) if piece == mark], len(pieces)]:
            out.append(tuple(self._with_bytes(pieces[begin:border])))
            begin = border + 1
        return out

    @staticmethod
    def _learnt(memory: Memory, keys: list[str], learn: Callable[[list[str]], list[tuple[int, ...]]]) -> list[tuple[int, ...]]:
        """The values of the keys: remembered ones, and those that ``learn`` makes of the others."""
        values, missing = memory.find(keys)
        if missing:
            new = list(dict.fromkeys([keys[i] for i in missing]))
            fresh = dict(zip(new, learn(new)))
            for key, value in fresh.items():
                if len(key) <= LONGEST_KEY:
                    memory.keep(key, value)
            for i in missing:
                values[i] = fresh[keys[i]]
        return values

    def _words(self, words: list[str]) -> list[tuple[int, ...]]:
        cut = [[SPACE + w] if w.isalpha() else self.cut.split(SPACE + w) for w in words]
        values = iter(self._learnt(self.parts, list(chain.from_iterable(cut)), self._encoded))
        return [next(values) if len(c) == 1 else tuple(chain.from_iterable(islice(values, len(c)))) for c in cut]

    def __call__(self, text: str | None) -> list[int]:
        """The ids of a text."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        words = _WORD.findall(marked) if SPACE * 2 in marked else marked[1:].split(SPACE)
        return list(chain.from_iterable(self._learnt(self.words, words, self._words)))


@lru_cache(maxsize=1)
def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder, which keeps what it remembers between tasks."""
    return PieceEncoder(path)


def _list_column(rows: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int32, int(ends[-1]))))


def _coded(documents: DataFrame, model: str, folder: str | None, decoded: bool) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = piece_encoder(vocabulary_path(model, folder))
        for batch in batches:
            rows = [encode(t) for t in batch.column(1).to_pylist()]
            columns = {"doc_id": batch.column(0), "ids": _list_column(rows)}
            if decoded:
                columns["decoded"] = pa.array([encode.library.decode(r) if r else "" for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    fields = [documents.schema["doc_id"], StructField("ids", ArrayType(IntegerType(), False), False)]
    fields += [StructField("decoded", StringType(), False)] if decoded else []
    return documents.select("doc_id", "text").mapInArrow(code, StructType(fields))


def encode(documents: DataFrame, model: str = MODEL, folder: str | None = None) -> DataFrame:
    """``doc_id, ids`` of each row's text, without begin and end ids."""
    return _coded(documents, model, folder, False)


def encode_and_decode(documents: DataFrame, model: str = MODEL, folder: str | None = None) -> DataFrame:
    """``doc_id, ids, decoded``: the ids of each row's text and the text that the library makes of them."""
    return _coded(documents, model, folder, True)


def decode(ids: DataFrame, model: str = MODEL, folder: str | None = None) -> DataFrame:
    """``doc_id, text`` from a table with ``doc_id`` and ``ids``; null ids are an empty text."""

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = piece_encoder(vocabulary_path(model, folder)).library
        for batch in batches:
            texts = [library.decode(r) if r else "" for r in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return ids.select("doc_id", "ids").mapInArrow(back, StructType([ids.schema["doc_id"], StructField("text", StringType(), False)]))
