"""Byte-pair encoding and decoding with a given public vocabulary.

Every token is a byte string. A pair of neighbouring bytes that stands inside
no token of the vocabulary can never be merged across, because each merge
result is itself a token: between such bytes there is a certain cut. The text
is split by the vocabulary's word pattern, words are cut at their certain
boundaries, each fragment is merged on its own, and the ids are concatenated.
Workers remember recent short spans of text; the memory for that is bounded.

Nulls and odd rows: null and empty texts have no tokens and decode to an empty
text; texts of any length are taken in pieces; repeated rows and null ids are
encoded like others; an empty table gives an empty result; further columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

#: The word pattern of byte-level vocabularies (fixed value).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters taken at a time, and spans remembered by a worker.
PIECE = 1 << 18
GROUP = 1 << 21
SPANS_AT_ONCE = 1 << 15
REMEMBERED = 1 << 18
#: Fragments up to this length are merged many at a time, longer ones one by one with a heap.
SHORT = 32
ROWS_AT_ONCE = 1 << 14
NO_RANK = 1 << 30

_word = regex.compile(WORDS)
_beyond = regex.compile(r"[^\x00-\u052f]")
_safe_cut = re.compile(r"(?<=\S) (?=\S)")
_rare_space = re.compile(r"[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_library = pre_tokenizers.ByteLevel(add_prefix_space=False)


def split_words(text: str) -> list[str]:
    """Words by the pattern. Beyond U+052F the tables of the two pattern libraries differ, so there the
    tokenizers library says where words end."""
    if _beyond.search(text):
        return [text[a:b] for _, (a, b) in _library.pre_tokenize_str(text)]
    return _word.findall(text)


def split_spans(text: str) -> Iterator[list[str]]:
    """Lists of spans: a span ends where a single space stands between two other characters, before which
    every word ends for certain. Lists hold about ``PIECE`` characters, or more where there is no such space."""
    start = 0
    while start < len(text):
        end = len(text)
        if end - start > PIECE and (cut := _safe_cut.search(text, start + PIECE)):
            end = cut.start()
        piece = text[start:end] if end - start < len(text) else text
        if "  " in piece or " \n" in piece or "\n " in piece or _rare_space.search(piece):
            parts = _safe_cut.split(piece)
        else:
            parts = piece.split(" ")
        first, *rest = parts
        yield ([first] if first else []) + [" " + part for part in rest]
        start = end


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and tokens of a tokenizer file, read from its JSON text."""

    def __init__(self, content: str):
        data = json.loads(content)
        byte_of = _byte_of_character()
        raw = {token: bytes(byte_of[c] for c in token) for token in data["model"]["vocab"]}
        ids = data["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes_of = {i: raw[token] for token, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.single = np.zeros(256, dtype=np.int64)
        for token, i in ids.items():
            if len(raw[token]) == 1:
                self.single[raw[token][0]] = i
        #: Rank of a pair of ids (in one number), and the id that the merge of a rank gives.
        self.rank_of, self.merged_of = {}, []
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank_of[ids[a] << 20 | ids[b]] = rank
            self.merged_of.append(ids[a + b])
        self.merged_of = np.array(self.merged_of, dtype=np.int64)
        self.pair_keys = np.array(sorted(self.rank_of), dtype=np.int64)
        self.pair_ranks = np.array([self.rank_of[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        #: Pairs of bytes inside some token; between all others there is a certain cut.
        self.joined = np.zeros(1 << 16, dtype=bool)
        for token in raw.values():
            for a, b in zip(token, token[1:]):
                self.joined[a << 8 | b] = True
        self._specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self._spans: dict[str, tuple[str, int, bytes]] = {}
        self._older: dict[str, tuple[str, int, bytes]] = {}

    def _cuts(self, raw: np.ndarray) -> np.ndarray:
        """True at each byte before which there is a certain cut."""
        cut = np.ones(len(raw), dtype=bool)
        cut[1:] = ~self.joined[raw[:-1].astype(np.uint16) << 8 | raw[1:]]
        return cut

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NO_RANK)

    def _merge_many(self, ids: np.ndarray) -> np.ndarray:
        """Merge rows of ids (-1 behind the end): in every row the pair of the lowest rank, leftmost first, until none is left."""
        rows, width = ids.shape
        if width < 2:
            return ids
        ranks = np.full((rows, width), NO_RANK, dtype=np.int64)
        ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[:, :-1][ids[:, 1:] < 0] = NO_RANK
        out, place, columns = ids.copy(), np.arange(rows), np.arange(width)
        while len(place):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(place)), at]
            done = best == NO_RANK
            if done.any():
                out[place[done]] = ids[done]
                ids, ranks, place, at, best = ids[~done], ranks[~done], place[~done], at[~done], best[~done]
                if not len(place):
                    break
            every = np.arange(len(place))
            # Close the gap: what stands right of the merged pair moves one place to the left.
            take = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, take, axis=1), np.take_along_axis(ranks, take, axis=1)
            ids[:, -1], ranks[:, -1] = -1, NO_RANK
            ids[every, at] = self.merged_of[best]
            for column in (at - 1, at):
                valid = (column >= 0) & (column < width - 1)
                r, c = every[valid], column[valid]
                right = ids[r, c + 1]
                ranks[r, c] = np.where(right < 0, NO_RANK, self._ranks(ids[r, c], right))
        return out

    def encode_spans(self, spans: list[str]) -> list[list[int]]:
        """Ids of each span. Spans end where words end for certain, so they are split as one text."""
        plain = [span[0] == " " and not span[-1].isspace() for span in spans]
        words = []
        for joinable, group in groupby(zip(plain, spans), key=itemgetter(0)):
            texts = [span for _, span in group]
            for text in ["".join(texts)] if joinable else texts:
                words += [word.encode() for word in split_words(text)]
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        cut = self._cuts(raw)
        ends = np.cumsum([len(w) for w in words])
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(raw)))
        merged: list[np.ndarray] = []
        order: list[np.ndarray] = []
        low = 0
        for high in (1, 4, 8, 16, SHORT):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            low = high
            for part in np.array_split(rows, len(rows) // ROWS_AT_ONCE + 1):
                if len(part):
                    at = starts[part][:, None] + np.arange(high)
                    ids = np.where(np.arange(high) < sizes[part][:, None], self.single[raw[np.minimum(at, len(raw) - 1)]], -1)
                    ids = self._merge_many(ids)
                    keep = ids >= 0
                    merged.append(ids[keep])
                    order.append(np.repeat(starts[part], keep.sum(axis=1)))
        for row in np.flatnonzero(sizes > SHORT):
            ids = self._merge_long(self.single[raw[starts[row] : starts[row] + sizes[row]]].tolist())
            merged.append(np.array(ids))
            order.append(np.full(len(ids), starts[row]))
        places = np.concatenate(order)
        sort = np.argsort(places, kind="stable")
        flat, places = np.concatenate(merged)[sort].tolist(), places[sort]
        lengths = np.cumsum([len(span.encode()) for span in spans])
        stops = np.searchsorted(places, lengths).tolist()
        return [flat[a:b] for a, b in zip([0, *stops], stops)]

    def _merge_long(self, ids: list[int]) -> list[int]:
        rank_of, n = self.rank_of, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (rank := rank_of.get(ids[i] << 20 | ids[j])) is not None:
                heapq.heappush(queue, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while queue:
            rank, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = int(self.merged_of[rank]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [x for x in ids if x >= 0]

    def pieces(self, text: str) -> Iterator[tuple[list[str], int | None]]:
        """Spans of a text, then the special token that follows them, if any."""
        start = 0
        for found in self._specials.finditer(text) if self._specials else ():
            for spans in split_spans(text[start : found.start()]):
                yield spans, None
            yield [], self.special[found[0]]
            start = found.end()
        for spans in split_spans(text[start:] if start else text):
            yield spans, None

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for spans, special in self.pieces(text):
            if spans:
                for part in self.encode_spans(spans):
                    ids += part
            if special is not None:
                ids.append(special)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode(errors="replace")

    def _learn(self, spans: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """Ids as text, their number, and the text that they decode to, of every span."""
        if len(self._spans) >= REMEMBERED // 2:
            self._older, self._spans = self._spans, {}
        known, older = self._spans, self._older
        new = sorted(span for span in spans if span not in known)
        again = [span for span in new if span in older]
        known.update((span, older[span]) for span in again)
        new = [span for span in new if span not in older]
        for start in range(0, len(new), SPANS_AT_ONCE):
            part = new[start : start + SPANS_AT_ONCE]
            for span, ids in zip(part, self.encode_spans(part)):
                known[span] = (",".join(map(str, ids)), len(ids), self.decode(ids).encode())
        return known

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Per text the number of ids, and SHA-256 of the ids and of the decoded text.

        New spans of about ``GROUP`` characters are merged together; a longer text is taken in several groups.
        """
        steps: list[tuple[list[str], int | None, bool]] = []
        held, state = 0, None

        def flush() -> Iterator[tuple[int, str, str]]:
            nonlocal state
            known = self._learn(set(chain.from_iterable(step[0] for step in steps)))
            for spans, special, ends in steps:
                count, id_hash, text_hash = state or (0, hashlib.sha256(), hashlib.sha256())
                # Spans begin and end with whole characters, so each decodes on its own.
                got = [known[span] for span in spans] if special is None else [(str(special), 1, self.bytes_of[special])]
                if got:
                    ids, counts, decoded = zip(*got)
                    id_hash.update(("," * (count > 0) + ",".join(ids)).encode())
                    text_hash.update(b"".join(decoded))
                    count += sum(counts)
                state = None if ends else (count, id_hash, text_hash)
                if ends:
                    yield count, id_hash.hexdigest(), text_hash.hexdigest()
            steps.clear()

        for text in texts:
            for spans, special in self.pieces(text):
                steps.append((spans, special, False))
                held += sum(map(len, spans)) if len(text) > PIECE else 0
                if held >= GROUP:
                    yield from flush()
                    held = 0
            steps.append(([], None, True))
            held += len(text) if len(text) <= PIECE else 0
            if held >= GROUP:
                yield from flush()
                held = 0
        yield from flush()

    def digest(self, text: str) -> tuple[int, str, str]:
        return next(self.digests([text]))


_loaded: dict[str, Vocabulary] = {}


def _vocabulary(content: str) -> Vocabulary:
    """One per worker and file."""
    key = hashlib.sha256(content.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(content)
    return _loaded[key]


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text."""
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            ids = [vocabulary.encode(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _narrow(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""
    content = encoded.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            texts = [vocabulary.decode(i.as_py() or []) for i in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass."""
    content = docs.sparkSession.sparkContext.broadcast(_content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(content.value)
        for batch in batches:
            rows = list(vocabulary.digests(t.as_py() or "" for t in batch.column(1)))
            counts, ids, texts = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _narrow(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
