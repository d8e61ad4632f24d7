"""SentencePiece encoding and decoding with a given public model of merge type.

The ids are those of merging the best pair first, found without merging the text:
only one sequence of pieces covers a text so that each two neighbours, merged
anew on their own, give these two pieces again. An Aho-Corasick automaton names
the longest piece at a place; it is taken if it goes with the piece before it,
otherwise its next shorter prefix is tried, and where none is left the search
steps back and marks the place as failed in a bitfield, so that no place is
tried twice. Pieces that merging can never give are left out when the model is
read.

A text is first cut where no piece holds the two neighbouring characters; words
that were met lately are remembered, in a bounded number of characters.

Nulls and odd rows: null and empty texts have the begin and end ids only and
decode to an empty text; characters that the model lacks become byte pieces;
texts of any length are taken in portions; repeated rows and null ids are
encoded like others; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
#: Characters of a text taken at a time, and places whose longest pieces are looked up at a time.
PORTION = 1 << 18
WINDOW = 1 << 12
#: Words and fragments up to this length are remembered, up to so many characters of each, of words twice.
WORD = 48
REMEMBERED = 1 << 22
PAIRS_KEPT = 1 << 19

_word = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_border = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and contents of the fields of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(tag & 7) or number()
        yield tag >> 3, raw[at : at + size]
        at += size


class Model:
    """Pieces of a model file, and the search for the pieces of a text."""

    def __init__(self, raw: bytes):
        pieces, trainer, normaliser = [], {}, {}
        for field, content in _fields(raw):
            if field == 1:
                piece = dict(_fields(content))
                pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
            elif field == 2:
                trainer = dict(_fields(content))
            elif field == 3:
                normaliser = dict(_fields(content))
        if {kind for _, _, kind in pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE} or trainer.get(3) != 2 or not trainer.get(35):
            raise ValueError("a model of merge type with byte pieces and without user-defined pieces is needed")
        if normaliser.get(2) or normaliser.get(4, 1) or not normaliser.get(3, 1) or not normaliser.get(5, 1):
            raise ValueError("the model changes the text before it is encoded")
        self.begin, self.end, self.unknown = trainer.get(41, 1), trainer.get(42, 2), trainer.get(40, 0)
        self.unknown_text = trainer.get(44, b" \xe2\x81\x87 ").decode()
        self.kinds = [kind for _, _, kind in pieces]
        self.byte_ids = [0] * 256
        self.byte_of = {}
        for i, (text, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_of[i] = int(text[3:5], 16)
                self.byte_ids[int(text[3:5], 16)] = i
        self.scores = {text: score for text, score, kind in pieces if kind == NORMAL}
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == NORMAL}
        # What merging never gives can't stand in a result.
        for text in [t for t in self.ids if len(t) > 1 and self.merged(t) != [t]]:
            del self.ids[text]
        self.longest_piece = max(map(len, self.ids), default=1)
        self.joined = {pair for text in self.ids for pair in zip(text, text[1:])}
        self.plain = [text.replace(SPACE, " ") if kind == NORMAL else None for text, _, kind in pieces]
        self.words_end_at_spaces = not any(pair[1] == SPACE != pair[0] for pair in self.joined)
        self.texts = [text for text, _, _ in pieces]
        self.lengths = [len(text) for text in self.texts]
        #: The next shorter piece that a piece begins with, or -1.
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in self.texts]
        self.automaton = ahocorasick.Automaton()
        for text, i in self.ids.items():
            self.automaton.add_word(text, (i, len(text) - 1))
        if self.ids:
            self.automaton.make_automaton()
        self._pairs: dict[int, bool] = {}
        self._known: dict[str, tuple[bytes, bytes]] = {}
        self._older: dict[str, tuple[bytes, bytes]] = {}
        self._held = 0
        self._fragments: dict[str, list[int]] = {}
        self._fragment_size = 0

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the pair of the best score, leftmost first, until none is left."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _go_together(self, pair: int) -> bool:
        """Whether two neighbours (ids in one number) stay as they are when their text is merged anew."""
        if len(self._pairs) >= PAIRS_KEPT:
            self._pairs.clear()
        left, right = self.texts[pair >> 24], self.texts[pair & 0xFFFFFF]
        known = self._pairs[pair] = self.merged(left + right) == [left, right]
        return known

    def _longest(self, text: str) -> list[int]:
        """The longest piece from every place of a short text."""
        found = [-1] * len(text)
        for last, (piece, before) in self.automaton.iter(text):
            # Of pieces from one place the longest ends last, so it is the one that stays.
            found[last - before] = piece
        return found

    def search(self, text: str) -> list[int]:
        """Ids of a text whose characters the model has."""
        ids: list[int] = []
        shorter, lengths, pairs, size = self.shorter, self.lengths, self._pairs, len(text)
        failed = bytearray((size >> 3) + 1)
        # Longest pieces from ``base`` on; they are looked up by windows, as the search only moves a few places back.
        base, found = 0, self._longest(text[: WINDOW + self.longest_piece])
        at, before = 0, -1
        piece = found[0] if size else -1
        while at < size:
            while piece >= 0:
                end = at + lengths[piece]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if before < 0:
                        break
                    good = pairs.get(before << 24 | piece)
                    if good or good is None and self._go_together(before << 24 | piece):
                        break
                piece = shorter[piece]
            if piece >= 0:
                ids.append(piece)
                at, before = end, piece
                if at < size:
                    if not base <= at < base + WINDOW:
                        base = at - at % WINDOW
                        found = self._longest(text[base : base + WINDOW + self.longest_piece])
                    piece = found[at - base]
            elif before < 0:
                raise ValueError("no sequence of pieces covers the text")
            else:
                failed[at >> 3] |= 1 << (at & 7)
                ids.pop()
                at -= lengths[before]
                piece = shorter[before]
                before = ids[-1] if ids else -1
        return ids

    def _fragment_ids(self, part: str) -> list[int]:
        whole = self.ids.get(part)
        if whole is not None:
            return [whole]
        if len(part) == 1:
            return [self.byte_ids[byte] for byte in part.encode()]
        known = self._fragments.get(part)
        if known is None:
            known = self.search(part)
            if len(part) <= WORD:
                if self._fragment_size >= REMEMBERED:
                    self._fragments, self._fragment_size = {}, 0
                self._fragments[part] = known
                self._fragment_size += len(part)
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of a text, which is first cut where no piece holds the two neighbouring characters."""
        joined = self.joined
        cuts = [i for i, pair in enumerate(zip(word, word[1:]), 1) if pair not in joined]
        if not cuts:
            return self._fragment_ids(word)
        ids: list[int] = []
        start = 0
        for end in [*cuts, len(word)]:
            ids += self._fragment_ids(word[start:end])
            start = end
        return ids

    def words(self, text: str) -> Iterator[list[str]]:
        """Lists of words of a text, spaces written as the model has them; lists hold about ``PORTION`` characters,
        or more where no word ends."""
        start = 0
        while start < len(text):
            end = len(text)
            if end - start > PORTION:
                # Look for a border in the text as it is: a space or its sign after another character.
                found = _text_border.search(text, start + PORTION)
                end = found.start() if found else end
            part = text[start:end].replace(" ", SPACE)
            part = SPACE + part if start == 0 else part
            start = end
            if not self.words_end_at_spaces:
                yield [part]
            elif SPACE * 2 in part or part[0] != SPACE:
                yield _word.findall(part)
            else:
                yield [SPACE + word for word in part.split(SPACE)[1:]]

    def encode(self, text: str) -> list[int]:
        if not self.words_end_at_spaces:
            return [self.begin, *(self.word_ids(SPACE + text.replace(" ", SPACE)) if text else ()), self.end]
        return [self.begin, *(i for part in self.words(text) for word in part for i in self.word_ids(word)), self.end]

    def _decoded(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of every id, with the first space of the text; byte pieces in a row are read together."""
        held = bytearray()

        def flush() -> str:
            # A byte that begins no valid character stands for itself as a replacement character.
            text, at = [], 0
            while at < len(held):
                for size in (1, 2, 3, 4):
                    try:
                        text.append(held[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    text.append("�")
                    at += 1
            held.clear()
            return "".join(text)

        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                yield flush()
            kind = self.kinds[i]
            yield "" if kind == CONTROL else self.unknown_text if kind == UNKNOWN else self.plain[i]
        if held:
            yield flush()

    def decode(self, ids: Iterable[int]) -> str:
        ids = list(ids)
        text = "".join(self._decoded(ids))
        # A space that the first piece begins with is the one that encoding added.
        first = next((self.plain[i] for i in ids if self.kinds[i] != CONTROL), None)
        return text[1:] if first and first[0] == " " else text

    def _learn(self, word: str) -> tuple[bytes, bytes]:
        """Packed ids of a word, and the text that they decode to, with its first space."""
        got = self._older.get(word)
        if got is None:
            ids = self.word_ids(word)
            texts = [self.plain[i] for i in ids]
            got = (struct.pack(f"<{len(ids)}I", *ids), "".join(self._decoded(ids) if None in texts else texts).encode())
        if len(word) <= WORD:
            if self._held >= REMEMBERED:
                self._older, self._known, self._held = self._known, {}, 0
            self._known[word] = got
            self._held += len(word)
        return got

    def digest(self, text: str) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the packed ids and of the decoded text."""
        id_hash, text_hash = hashlib.sha256(struct.pack("<I", self.begin)), hashlib.sha256()
        count, first = 2, True
        parts = self.words(text) if self.words_end_at_spaces else [[SPACE + text.replace(" ", SPACE)]] if text else []
        for words in parts:
            got = list(map(self._known.get, words, repeat(None)))
            if None in got:
                got = [known or self._known.get(word) or self._learn(word) for known, word in zip(got, words)]
            packed = b"".join([ids for ids, _ in got])
            id_hash.update(packed)
            count += len(packed) // 4
            # The first word begins with the space that encoding adds.
            text_hash.update(b"".join([decoded for _, decoded in got])[first:])
            first = False
        id_hash.update(struct.pack("<I", self.end))
        return count, id_hash.hexdigest(), text_hash.hexdigest()


_text_border = re.compile(f"(?<=[^ {SPACE}])(?=[ {SPACE}])")
_loaded: dict[str, Model] = {}


def _model(raw: bytes) -> Model:
    """One per worker and file."""
    key = hashlib.sha256(raw).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Model(raw)
    return _loaded[key]


def _content(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int, with begin and end) of every text."""
    raw = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for batch in batches:
            ids = [model.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _narrow(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    raw = encoded.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for batch in batches:
            texts = [model.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass."""
    raw = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw.value)
        for batch in batches:
            rows = [model.digest(t.as_py() or "") for t in batch.column(1)]
            counts, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
