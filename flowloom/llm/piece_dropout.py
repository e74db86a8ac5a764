"""SentencePiece encoding and decoding with seeded merge-dropout.

A word starts as its characters. The agenda holds a candidate for each pair of neighbours that
make a piece; the best one (highest score, then leftmost) is merged and brings new candidates with
its neighbours. A candidate is skipped for good if the keyed hash of (seed, document, number of the word in it,
begin, middle, end) falls below the dropout rate: the same seed gives the same segmentation on any machine, another
seed another one, and each decodes to the text. A document's key is a hash of its id and text, so each
occurrence of a word is cut on its own, within a document and across documents.

Pieces never go on across a space, so words are independent; all words of a batch
are merged together, one merge of each word at a time; only their characters are kept from batch to batch.
Characters without a piece become bytes.

Cases: a null text is an empty one with no ids; the character U+2581 stands for a space in this format, so
a text that holds it decodes to a space there and is reported as not lossless; repeated rows each
get a row, the same for the same id and text; a null id is like any other; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.llm.inputs import in_slices, texts
from flowloom.llm.tokens import CutMemo, KeyTable, Ragged, text_bytes

DROPOUT = 0.1
SEED = 1
MARK = "▁"
LONG_WORD = 256
# Symbols of words of one length that are merged together.
TOGETHER = 1 << 19
NONE = np.int32(1 << 30)
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_OPEN: dict[tuple, Segmenter] = {}


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Pieces:
    """Vocabulary of a model file: symbols, which pairs merge to what, and bytes of each id."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.count = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(self.count)]
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(self.count)]
        self.symbols = {n: i for i, (n, s) in enumerate(zip(names, special)) if not s}
        if any(MARK in n[1:] and n.strip(MARK) for n in self.symbols) or model.decode(model.encode(" a  b\n")) != " a  b\n":
            raise ValueError("words of this model are not independent, or its texts are normalised")
        self.byte_ids = {int(n[3:5], 16): i for i, n in enumerate(names) if model.is_byte(i)}
        scores = {i: model.get_score(i) for i in self.symbols.values()}
        ranks = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        # What each symbol is written as: itself, or the bytes of a character without a piece.
        self.written = Ragged()
        self.written.append(np.arange(self.count, dtype=np.uint32), np.ones(self.count, np.int64))
        for char in sorted({c for n in self.symbols for c in n}):
            self.symbol(char)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for name, piece in list(self.symbols.items()):
            for i in range(1, len(name)) if piece < self.count else ():
                left, right = self.symbols.get(name[:i]), self.symbols.get(name[i:])
                if left is not None and right is not None:
                    self.pairs[left, right] = (ranks[scores[piece]], piece)
        keys = np.array([(a << 32) | b for a, b in self.pairs], np.uint64)
        self.table = KeyTable()
        self.table.add(_mix(keys), np.arange(len(keys), dtype=np.int32))
        self.rank = np.array([r for r, _ in self.pairs.values()] + [NONE], np.int32)
        self.merged = np.array([p for _, p in self.pairs.values()] + [0], np.int64)
        self.bytes = Ragged()
        raw = [bytes([int(n[3:5], 16)]) if model.is_byte(i) else b"" if s else n.replace(MARK, " ").encode() for i, (n, s) in enumerate(zip(names, special))]
        self.bytes.append(np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw))))

    def symbol(self, char: str) -> int:
        """The symbol of a character; a new one if it has no piece."""
        if char not in self.symbols:
            self.symbols[char] = self.written.rows
            spelled = [self.byte_ids[b] for b in char.encode()]
            self.written.append(np.array(spelled, np.uint32), np.array([len(spelled)]))
        return self.symbols[char]

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Number of the pair, or that of no pair (the last)."""
        keys = _mix((left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64))
        return self.table.find(keys.ravel()).reshape(left.shape)


class Segmenter:
    """Segments words with dropout, each occurrence by a key of its own; a memo of the symbols of words.

    ``words`` and ``agenda`` cut a word by (seed, stream, word); any number of streams can be asked for.
    """

    def __init__(self, path: str, rate: float, seed: int, streams: int = 1) -> None:
        self.pieces, self.rate, self.seed, self.streams = Pieces(path), rate, seed, streams
        self.limit = np.uint64(min(int(rate * (1 << 53)), (1 << 53)))
        self.memo = CutMemo(self._learn)

    def skipped(self, word: np.ndarray, begin: np.ndarray, middle: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether the keyed hash drops the candidates."""
        place = (begin.astype(np.uint64) << np.uint64(42)) ^ (middle.astype(np.uint64) << np.uint64(21)) ^ end.astype(np.uint64)
        return (_mix(word ^ _mix(place + np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(11)) < self.limit

    def _key(self, word: str, stream: int) -> int:
        return xxhash.xxh64_intdigest(word.encode(), (self.seed << 8 | stream) & (1 << 64) - 1)

    def _together(self, symbols: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of words of one length, and how many of a row count: each round merges the best candidate of each word."""
        count, length = symbols.shape
        bounds = np.repeat(np.arange(length + 1, dtype=np.int64)[None, :], count, 0)
        rows, done, counts = np.arange(count), np.zeros((count, length), np.int64), np.zeros(count, np.int64)

        def ranked(left, right, begin, middle, end, key):
            pair = self.pieces.look(left, right)
            rank = self.pieces.rank[pair]
            rank[self.skipped(key, begin, middle, end)] = NONE
            return rank, pair

        rank, pair = ranked(symbols[:, :-1], symbols[:, 1:], bounds[:, :-2], bounds[:, 1:-1], bounds[:, 2:], keys[:, None])
        while len(rows):
            best = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            live = rank[np.arange(len(rows)), best] < NONE if rank.shape[1] else np.zeros(len(rows), bool)
            done[rows[~live], : symbols.shape[1]] = symbols[~live]
            counts[rows[~live]] = symbols.shape[1]
            rows, symbols, bounds, rank, pair, best, keys = (x[live] for x in (rows, symbols, bounds, rank, pair, best, keys))
            if not len(rows):
                break
            n, at = len(rows), np.arange(len(rows))
            symbols[at, best] = self.pieces.merged[pair[at, best]]
            keep = np.ones(symbols.shape, bool)
            keep[at, best + 1] = False
            symbols = symbols[keep].reshape(n, -1)
            keep = np.ones(bounds.shape, bool)
            keep[at, best + 1] = False
            bounds = bounds[keep].reshape(n, -1)
            keep = np.ones(rank.shape, bool)
            keep[at, best] = False
            rank, pair = rank[keep].reshape(n, -1), pair[keep].reshape(n, -1)
            # The merged symbol has new candidates to its left (place best - 1) and right (place best).
            for place in (best - 1, best):
                r = np.flatnonzero((place >= 0) & (place < rank.shape[1]))
                p = place[r]
                rank[r, p], pair[r, p] = ranked(symbols[r, p], symbols[r, p + 1], bounds[r, p], bounds[r, p + 1], bounds[r, p + 2], keys[r])
        return done, counts

    def agenda(self, word: str, stream: int) -> list[int]:
        """Final symbols of one word, by a heap; for long words, and the plain form of the same rule."""
        return self._agenda([self.pieces.symbol(c) for c in word], np.uint64(self._key(word, stream)))

    def _agenda(self, symbol: list[int], key: np.uint64) -> list[int]:
        pieces = self.pieces
        after, before, end = list(range(1, len(symbol) + 1)), list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(symbol) and (found := pieces.pairs.get((symbol[i], symbol[j]))):
                heapq.heappush(heap, (found[0], i, end[i], end[j]))

        for i in range(len(symbol)):
            offer(i)
        while heap:
            _, i, middle, last = heapq.heappop(heap)
            j = after[i] if symbol[i] >= 0 else len(symbol)
            if j >= len(symbol) or end[i] != middle or end[j] != last:
                continue
            if self.skipped(key, np.array([i]), np.array([middle]), np.array([last]))[0]:
                continue
            symbol[i], symbol[j], end[i], after[i] = pieces.pairs[symbol[i], symbol[j]][1], -1, last, after[j]
            if after[i] < len(symbol):
                before[after[i]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [s for s in symbol if s >= 0]

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the characters of words, and how many each has."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        chars, back = np.unique(points, return_inverse=True)
        return np.array([self.pieces.symbol(chr(c)) for c in chars.tolist()], np.int64)[back] if len(chars) else np.zeros(0, np.int64), lengths

    def cut(self, symbols: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words by the symbols of their characters and a key for each, and how many each has."""
        starts = np.cumsum(lengths) - lengths
        flat, counts = np.zeros(len(symbols), np.int64), np.zeros(len(lengths), np.int64)
        for length in np.unique(lengths).tolist():
            alike = np.flatnonzero(lengths == length)
            if length > LONG_WORD:
                for i in alike.tolist():
                    found = self._agenda(symbols[starts[i] : starts[i] + length].tolist(), keys[i])
                    flat[starts[i] : starts[i] + len(found)], counts[i] = found, len(found)
                continue
            for begin in range(0, len(alike) if length else 0, step := max(1, TOGETHER // max(1, length))):
                at = alike[begin : begin + step]
                places = starts[at][:, None] + np.arange(length)
                flat[places], counts[at] = self._together(symbols[places], keys[at])
        # A word's final symbols are the first of its places.
        inside = np.arange(len(flat)) - np.repeat(starts, lengths) < np.repeat(counts, lengths)
        final = flat[inside]
        sizes = np.concatenate([[0], np.cumsum(self.pieces.written.size[final])])
        last = np.cumsum(counts)
        return self.pieces.written.gather(final), sizes[last] - sizes[last - counts]

    def words(self, words: list[str], stream: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words (each beginning with its marks) in a stream, and how many each has."""
        return self.cut(*self.symbols(words), np.fromiter((self._key(w, stream) for w in words), np.uint64, len(words)))

    def _learn(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = np.array([not c.strip(" ") for c in cuts], bool)
        sizes = np.zeros(len(cuts), np.int64)
        found, sizes[~odd] = self.symbols([MARK + c.removeprefix(" ") for c, o in zip(cuts, odd) if not o])
        return found.astype(np.uint32), sizes, odd

    def _keys(self, text: str, doc: int, numbers: np.ndarray) -> np.ndarray:
        """The key of each word of a document by its number."""
        own = np.uint64(xxhash.xxh64_intdigest(text.encode(), (self.seed * 0x9E3779B97F4A7C15 ^ doc) & (1 << 64) - 1))
        return _mix(own ^ _mix(numbers.astype(np.uint64) + np.uint64(1)))

    def whole(self, text: str, doc: int) -> np.ndarray:
        """Ids of a text with runs of spaces."""
        if not text:
            return np.zeros(0, np.uint32)
        words = _WORD.findall(MARK + text.replace(" ", MARK))
        return self.cut(*self.symbols(words), self._keys(text, doc, np.arange(len(words))))[0]

    def encode_all(self, array: pa.Array, docs: np.ndarray | int) -> list[np.ndarray]:
        """Ids of each text; ``docs`` has the ids of their documents, or one for all."""
        memo, texts_ = self.memo, array.to_pylist()
        docs = np.broadcast_to(np.asarray(docs, np.int64), len(texts_)).tolist()
        rows, counts = memo.rows(array)
        ends = np.cumsum(counts)
        # A word that holds the mark itself is cut there as well as at spaces.
        odd = [bool(memo.odd[rows[e - n : e]].any()) for e, n in zip(ends.tolist(), counts.tolist())]
        plain = np.repeat(~np.array(odd, bool), counts)
        keys = [self._keys(t, d, np.arange(n)) for t, d, n, o in zip(texts_, docs, counts.tolist(), odd) if not o]
        ids, sizes = self.cut(memo.ids.gather(rows[plain]).astype(np.int64), memo.ids.size[rows[plain]].astype(np.int64), np.concatenate(keys) if keys else np.zeros(0, np.uint64))
        own = np.where(odd, 0, counts)
        last = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum(own)]
        first = np.concatenate([[0], last[:-1]])
        return [self.whole(t, d) if o else ids[a:b] for t, d, o, a, b in zip(texts_, docs, odd, first.tolist(), last.tolist())]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids."""
        return self.pieces.bytes.gather(ids.astype(np.int64)).astype(np.uint8).tobytes().decode(errors="replace").removeprefix(" ")


def segmenter(path: str, rate: float, seed: int) -> Segmenter:
    key = (path, rate, seed)
    if key not in _OPEN:
        _OPEN[key] = Segmenter(*key)
    return _OPEN[key]


def encode(docs: DataFrame, path: str, *, rate: float = DROPOUT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_tokens, ids_crc32 (little-endian 32-bit ids), lossless and, unless left out, ids (as those bytes)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path, rate, seed)
        for batch in in_slices(batches, "text"):
            doc = batch.column("doc_id")
            found = own.encode_all(batch.column("text"), doc.fill_null(-1).to_numpy())
            data, bounds = text_bytes(batch.column("text"))
            raw, back = data.tobytes(), own.pieces.bytes
            lossless = []
            for ids, a, b in zip(found, bounds[:-1].tolist(), bounds[1:].tolist()):
                spelled = back.gather(ids.astype(np.int64)).astype(np.uint8).tobytes()
                lossless.append(spelled.removeprefix(b" ") == raw[a:b])
            arrays = [doc, pa.array(np.diff(bounds)), pa.array([len(f) for f in found], pa.int64())]
            blobs = [f.astype("<u4").tobytes() for f in found]
            arrays += [pa.array([zlib.crc32(b) for b in blobs], pa.int64()), pa.array(lossless, pa.bool_())] + [pa.array(blobs, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_tokens", "ids_crc32", "lossless"] + ["ids"] * with_ids)

    narrow = texts(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return narrow.mapInArrow(each, "doc_id long, n_bytes long, n_tokens long, ids_crc32 long, lossless boolean" + ", ids binary" * with_ids)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of a table with ids, as ``encode`` gives it; null ids give a null text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = segmenter(path, 0.0, 0)
        for batch in in_slices(batches, "ids"):
            found = [None if b is None else own.decode(np.frombuffer(b, "<u4")) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(each, "doc_id long, text string")
