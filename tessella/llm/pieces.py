"""Encoding to the pieces of a public SentencePiece vocabulary, and back.

The vocabulary is of the merging kind (pairs merge by score, best first, leftmost on ties), for which summed scores give
other pieces than the library does. So the forward pass over a word's prefixes keeps, instead of a sum, the one last
piece that merging leaves at the end of each prefix: a piece may end a prefix if it survives merging next to the last
piece of the prefix before it. That state belongs to the prefix alone; distinct marked words are therefore sorted, which
lays out their trie, and walked depth first, each word going on from the states of the letters it shares with the one
before. The pieces are read off backwards as in Viterbi's algorithm. Letters without a piece become bytes. A unit that begins with
several marks is merged plainly, with a heap, so that its time follows its length.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import mapped, sliced, steps

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Spaces (a mark in the vocabulary's writing) with the word they lead, a word without one, or a line end.
_UNITS = re.compile(" +[^ \n]*|[^ \n]+|\n")
#: Bytes, about, of encoded words (in each of two generations) and of pairs of pieces that a Python worker remembers;
#: longer words than LONG aren't.
WORD_BYTES, PAIR_BYTES, LONG = 112_000_000, 96_000_000, 64
#: Bytes that a dictionary's entry takes besides its letters: key, value, and place.
ENTRY = 200
#: Letters from which merging keeps its candidates in a heap.
SHORT = 24


class Pieces:
    """A vocabulary: merge order and ids by piece, bytes by id. Only the vocabulary is read from the file."""

    def __init__(self, model: bytes):
        reader = sentencepiece.SentencePieceProcessor(model_proto=model)
        size = reader.get_piece_size()
        self.byte_ids = [0] * 256
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.parts: list[bytes] = [b""] * size
        for i in range(size):
            piece = reader.id_to_piece(i)
            if reader.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.parts[i] = bytes([int(piece[3:5], 16)])
            elif not (reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i)):
                piece = piece.replace(MARK, " ")
                self.ids[piece], self.score[piece] = i, reader.get_score(i)
                self.parts[i] = piece.encode()
        if any(" " in p.lstrip(" ") or "\n" in p for p in self.ids):
            raise ValueError("pieces that reach over words can't be encoded word by word")
        #: Ends of pieces of two letters or more: where a stretch to the left isn't one, no longer piece ends here.
        self.ends = {p[i:] for p in self.ids for i in range(len(p) - 1)}
        #: Whether merging makes a piece of its own letters, and whether it leaves a piece whole after another.
        self.whole: dict[str, bool] = {}
        self.beside: dict[tuple[str | None, str], bool] = {}
        self.code = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        #: Encoded words, and those of the generation before, from which a word that is met again comes back.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0

    def merged(self, text: str) -> list[str]:
        """Plain merging, best pair first and the leftmost of equal ones, for pairs of pieces and runs of marks."""
        if len(text) > SHORT:
            return self._merged_long(text)
        parts, score = list(text), self.score
        while True:
            best, at, before = -np.inf, -1, parts[0] if parts else ""
            for i in range(1, len(parts)):
                part = parts[i]
                value = score.get(before + part)
                if value is not None and value > best:
                    best, at = value, i
                before = part
            if at < 0:
                return parts
            parts[at - 1 : at + 1] = [parts[at - 1] + parts[at]]

    def _merged_long(self, text: str) -> list[str]:
        """The same with a heap of pairs and links between neighbours: n log n in the letters."""
        parts: list[str] = list(text)
        n, score = len(parts), self.score
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(-score[text[i : i + 2]], i, 1, 1) for i in range(n - 1) if text[i : i + 2] in score]
        heapq.heapify(heap)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i]
            if len(parts[i]) != left or j >= n or len(parts[j]) != right:
                continue  # one of the two has been merged meanwhile
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (before[i], i):
                b = after[a] if a >= 0 else n
                if b < n and (whole := parts[a] + parts[b]) in score:
                    heapq.heappush(heap, (-score[whole], a, len(parts[a]), len(parts[b])))
        return [p for p in parts if p]

    def _tried(self, last: str | None, piece: str) -> bool:
        """Whether merging leaves piece whole after last (None: at the start)."""
        ok = len(piece) == 1 or self.whole.get(piece)
        if ok is None:
            ok = self.whole[piece] = self.merged(piece) == [piece]
        if ok and last in self.ids and piece in self.ids:
            ok = self.merged(last + piece) == [last, piece]
        if len(self.beside) * ENTRY > PAIR_BYTES:
            self.beside.clear()
        self.beside[last, piece] = ok
        return ok

    def ids_of(self, parts: Iterable[str]) -> bytes:
        code = self.code
        return b"".join([code[p] if p in code else b"".join([self.byte_ids[b].to_bytes(4, "little") for b in p.encode()]) for p in parts])

    def learn(self, words: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct words, in one walk of their trie; a stack holds each prefix's last piece."""
        found: dict[str, bytes] = {}
        before = ""
        lasts: list[str | None] = [None]
        ends, ids, beside = self.ends, self.ids, self.beside
        for word in sorted(words):
            if word.startswith("  "):
                found[word] = self.ids_of(self.merged(word))
                continue
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del lasts[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                start = end - 1
                while start and word[start - 1 : end] in ends:
                    start -= 1
                for start in range(start, end):
                    piece = word[start:end]
                    if (piece in ids or end - start == 1) and (beside[key] if (key := (lasts[start], piece)) in beside else self._tried(*key)):
                        break
                lasts.append(piece)
            before, end, parts = word, len(word), []
            while end:
                parts.append(lasts[end])
                end -= len(lasts[end])
            found[word] = self.ids_of(reversed(parts))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian 32-bit numbers; an empty text has none."""
        units = [_UNITS.findall(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if self.held > WORD_BYTES:
            self.words, self.older, self.held = {}, self.words, 0
        known, older = self.words, self.older
        new = [w for w in set().union(*units) if w not in known]
        found = {w: older[w] for w in new if w in older}
        found |= self.learn([w for w in new if w not in found])
        known |= found
        out = [b"".join(map(known.__getitem__, u)) for u in units]
        for w in [w for w in found if len(w) > LONG]:
            del known[w]
        self.held += sum([len(w) + len(x) for w, x in found.items() if len(w) <= LONG]) + ENTRY * len(found)
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 text of ids; the mark put before a text is taken off."""
        text = b"".join(map(self.parts.__getitem__, np.frombuffer(ids, dtype="<i4").tolist()))
        return text[1:] if text[:1] == b" " else text


_LOADED: dict[bytes, Pieces] = {}


def _pieces(model: bytes) -> Pieces:
    key = hashlib.sha256(model).digest()
    if key not in _LOADED:
        _LOADED[key] = Pieces(model)
    return _LOADED[key]


def _lists(ids: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype="<i4")))


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_pieces``, ``ids`` (unless with_ids is false), ``ids_sha256``, ``round_trip`` of every row.

    round_trip: decoding gives the text back, but for marks in it, which become spaces. A null text counts as empty: no
    pieces, an empty hash input. The vocabulary file is read on the driver and broadcast (half a megabyte).
    """
    with open(model, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_pieces long, " + "ids array<int>, " * with_ids + "ids_sha256 string, round_trip boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for batch in sliced(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            raw = [t.encode() for t in texts]
            for a, b in steps(raw):
                ids = pieces.encode(texts[a:b])
                back = [pieces.decode(x) == t.replace(MARK.encode(), b" ") for x, t in zip(ids, raw[a:b])]
                columns = {
                    "doc_id": batch.column(0).slice(a, b - a),
                    "n_pieces": pa.array([len(x) // 4 for x in ids], pa.int64()),
                    "ids": _lists(ids) if with_ids else None,
                    "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    "round_trip": pa.array(back),
                }
                columns = {k: v for k, v in columns.items() if v is not None}
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return mapped(rows, run, schema)


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id``, ``text`` of every row of ids; null ids give a null text, bytes that aren't UTF-8 the replacement character."""
    with open(model, "rb") as file:
        shipped = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(shipped.value)
        for batch in sliced(batches):
            texts = [None if x is None else pieces.decode(np.array(x, dtype="<i4").tobytes()).decode(errors="replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return mapped(rows, run, "doc_id long, text string")
