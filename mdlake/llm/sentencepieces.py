"""SentencePiece encoding and decoding by Viterbi search over shared prefixes.

A text is escaped (a mark in front, marks for spaces) and cut into marked words; no
piece of the vocabulary reaches from one into the next, so the best segmentation
of a text is that of its words. A task sorts the distinct new words of a batch,
which lays them out as a trie, and walks it depth-first: the forward scores of a
prefix are computed once for all words that share it. Words a task has met before
come from its table, which is emptied when it is full.

Nothing is shuffled. The vocabulary is read once on the driver and sent with the task.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from mdlake.llm.tables import free_name
from mdlake.llm.words import flat, lists, slices

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
_KNOWN_WORDS, _KNOWN_CHARACTERS = 600_000, 8_000_000  # that a task remembers
_UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Vocabulary:
    scores: dict[str, tuple[int, float]]  # piece -> id, score
    texts: list[str]
    bytes_: list[int]  # ids of the 256 byte pieces
    unknown: float  # the score of a character that no piece covers
    longest: int

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        texts = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        scores = {texts[i]: (i, float(model.get_score(i))) for i in plain}
        of_bytes = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(model.is_byte, of_bytes)):
            raise ValueError("the vocabulary has no byte pieces")
        return cls(scores, texts, of_bytes, min(s for _, s in scores.values()) - _UNKNOWN_PENALTY, max(map(len, scores)))

    def prefixes(self) -> set[str]:
        return {p[:k] for p in self.scores for k in range(1, len(p) + 1)}


def words_of(text: str) -> list[str]:
    """The marked words of a text."""
    return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []


class Encoder:
    """Best segmentations of words; among equal scores the one whose last piece is longest, as the public library decides."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        by_end: dict[str, list[str]] = {}
        for p in vocabulary.scores:
            by_end.setdefault(p[-2:], []).append(p)
        # lengths of the pieces that end in given characters, longest first; those of one character are looked up by themselves
        self.lengths = {c: sorted({len(p) for p in ps}, reverse=True) for c, ps in by_end.items() if len(c) == 2}
        self.known: dict[str, bytes] = {}
        self.size = 0  # characters of known words

    def encode(self, words: set[str]) -> None:
        """Adds the words to ``known``, sorted as a trie and walked depth-first."""
        scores, lengths, unknown, single = self.v.scores, self.lengths, self.v.unknown, self.v.bytes_
        best, back, ids = [0.0], [0], [()]  # of each prefix of the current word: score, start and ids of the last piece
        before = ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], back[shared + 1 :], ids[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                c = word[end - 1]
                top, at, last = float("-inf"), -1, ()
                for n in lengths.get(word[end - 2 : end] if end > 1 else "", ()):  # longest first: the smallest start wins a tie
                    if n <= end:
                        piece = scores.get(word[end - n : end])
                        if piece is not None and best[end - n] + piece[1] > top:
                            top, at, last = best[end - n] + piece[1], end - n, (piece[0],)
                alone = scores.get(c)
                if best[end - 1] + (unknown if alone is None else alone[1]) > top:
                    top, at = best[end - 1] + (unknown if alone is None else alone[1]), end - 1
                    last = tuple(single[b] for b in c.encode()) if alone is None else (alone[0],)
                best.append(top)
                back.append(at)
                ids.append(last)
            end, parts = len(word), []
            while end:
                parts.append(ids[end])
                end = back[end]
            self.known[word] = array("i", [i for p in reversed(parts) for i in p]).tobytes()
            before = word

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        cut = [words_of(x or "") for x in texts]
        new = {w for ws in cut for w in ws}
        if len(self.known) + len(new) > _KNOWN_WORDS or self.size > _KNOWN_CHARACTERS:
            self.known.clear()
            self.size = 0
        new -= self.known.keys()
        self.size += sum(map(len, new))
        self.encode(new)
        known = self.known
        return [b"".join([known[w] for w in ws]) for ws in cut]


def decoder(vocabulary: Vocabulary):
    value = {i: b for b, i in enumerate(vocabulary.bytes_)}
    parts = [bytes([value[i]]) if i in value else t.replace(MARK, " ").encode() for i, t in enumerate(vocabulary.texts)]

    def decode(ids: list[int]) -> str:
        return b"".join([parts[i] for i in ids])[1:].decode("utf-8", "replace")

    return decode


def encode(docs: DataFrame, keep: list[str], text: str = "text", model: str = MODEL, verify: bool = False) -> DataFrame:
    """``keep`` columns of every row, with ``ids``: array of int; with ``verify`` also ``round_trip``, whether the ids decode to the text.

    A null or empty text has no ids. A text's own marks (U+2581) decode to spaces, as the format has it.
    """
    vocabulary = Vocabulary.load(model)
    out, whole = (free_name(docs.select(*keep), n) for n in ("ids", "round_trip"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, back, pool = Encoder(vocabulary), decoder(vocabulary), pa.default_memory_pool()
        for batch in slices(batches, text):
            pool.release_unused()  # a worker keeps what earlier batches, also of other queries, have left
            texts = batch.column(text).to_pylist()
            ids = encoder.batch(texts)
            column = lists(np.frombuffer(b"".join(ids), np.int32), np.array([len(i) // 4 for i in ids], np.int64), pa.int32())
            checks = [pa.array([back(np.frombuffer(i, np.int32).tolist()) == (x or "") for i, x in zip(ids, texts)])] if verify else []
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), column, *checks], [*keep, out, whole][: len(keep) + 1 + verify])

    more = [T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(whole, T.BooleanType())][: 1 + verify]
    kinds = T.StructType([*(T.StructField(docs.schema[c].name, docs.schema[c].dataType) for c in keep), *more])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, kinds)


def decode(encoded: DataFrame, ids: str = "ids", text: str = "decoded", model: str = MODEL) -> DataFrame:
    """``encoded`` with the text of its ids."""
    vocabulary = Vocabulary.load(model)
    out = free_name(encoded, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = decoder(vocabulary)
        for batch in batches:
            every, counts = flat(batch.column(ids))
            ends = np.cumsum(counts)
            known = batch.column(ids).is_valid().to_pylist()
            texts = [(back(every[b - n : b].tolist()) if n else "") if k else None for n, b, k in zip(counts.tolist(), ends.tolist(), known)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return encoded.mapInArrow(run, T.StructType([*(T.StructField(f.name, f.dataType) for f in encoded.schema), T.StructField(out, T.StringType())]))
