"""Token ids of whole texts, by the tokenizers library with a bounded memo of text cuts.

A text is cut before each space. The ids of a text are those of its cuts in order, as long
as no space follows other white space: byte-level and word tokenizers look only at the white
space in front of a piece. Texts that break this rule, or hold special strings, are given to
the library whole. Else each distinct cut is split by the vocabulary's pattern, and each
distinct pre-token passes the library's model, once per memo. Cuts are found and looked up
for a whole batch of texts at once: by position in the UTF-8 bytes and by a 64-bit key.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex

CUT_MEMO = 1 << 19
PIECE_MEMO = 250_000
LONGEST_KEPT = 48
SEPARATOR = "\x01"
# Fixed value: how byte-level pre-tokenizers cut a text.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_OPEN: dict[str, TextEncoder] = {}


def _room(array: np.ndarray, needed: int) -> np.ndarray:
    if needed <= len(array):
        return array
    return np.concatenate([array, np.zeros(max(needed, 2 * len(array)) - len(array), array.dtype)])


class Ragged:
    """Rows of ids, appended at the end and gathered by row number."""

    def __init__(self) -> None:
        self.flat = np.zeros(1 << 16, np.uint32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.rows = self.used = 0

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        begin, end = self.rows, self.rows + len(sizes)
        self.flat = _room(self.flat, self.used + len(ids))
        self.start, self.size = _room(self.start, end), _room(self.size, end)
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[begin:end] = sizes
        self.start[begin:end] = self.used + np.cumsum(sizes) - sizes
        self.used, self.rows = self.used + len(ids), end

    def gather(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        shift = np.repeat(self.start[rows] - (np.cumsum(size) - size), size)
        return self.flat[shift + np.arange(len(shift))]


class KeyTable:
    """Numbers of 64-bit keys, found and added for whole arrays (open addressing)."""

    def __init__(self, bits: int = 16) -> None:
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.full(1 << bits, -1, np.int32)
        self.filled = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        mask = np.uint64(len(self.keys) - 1)
        found = np.full(len(keys), -1, np.int32)
        left, at = np.arange(len(keys)), keys & mask
        while len(left):
            value = self.values[at]
            hit = (value >= 0) & (self.keys[at] == keys[left])
            found[left[hit]] = value[hit]
            on = (value >= 0) & ~hit
            left, at = left[on], (at[on] + np.uint64(1)) & mask
        return found

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that are not in the table."""
        if 2 * (self.filled + len(keys)) > len(self.keys):
            old = self.values >= 0
            keys, values = np.concatenate([self.keys[old], keys]), np.concatenate([self.values[old], values])
            self.__init__(max(16, int(4 * len(keys) - 1).bit_length()))
        self.filled += len(keys)
        mask = np.uint64(len(self.keys) - 1)
        at = keys & mask
        while len(keys):
            free = np.flatnonzero(self.values[at] < 0)
            slots, first = np.unique(at[free], return_index=True)
            won = free[first]
            self.keys[slots], self.values[slots] = keys[won], values[won]
            on = np.ones(len(keys), bool)
            on[won] = False
            keys, values, at = keys[on], values[on], (at[on] + np.uint64(1)) & mask


class Powers:
    """Powers of an odd number and of its inverse, one table for all users in a worker."""

    STEP = 0x9E3779B97F4A7C15

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, count: int) -> None:
        if len(self.up) < count:
            steps = np.full(count, self.STEP, np.uint64)
            steps[0] = 1
            self.up = np.cumprod(steps, dtype=np.uint64)
            steps[1:] = pow(self.STEP, -1, 1 << 64)
            self.down = np.cumprod(steps, dtype=np.uint64)


POWERS = Powers()


class CutFinder:
    """Places and keys of the cuts of a batch of texts."""

    def __init__(self) -> None:
        rng = np.random.default_rng(7)
        self.code = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)

    def __call__(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and key of each cut, and the number of cuts of each text.

        A cut begins at a space or at the begin of a text; the latter kind has keys of its own.
        """
        POWERS.reach(len(data) + 1)
        spaces = np.flatnonzero(data == 32)
        heads = bounds[:-1]
        begin = np.concatenate([heads, spaces])
        is_head = np.zeros(len(begin), bool)
        is_head[: len(heads)] = True
        order = np.lexsort((~is_head, begin)) if len(spaces) < len(heads) else np.argsort(begin, kind="stable")
        begin, is_head = begin[order], is_head[order]
        text = np.cumsum(is_head) - 1
        counts = np.bincount(text, minlength=len(heads))
        end = np.append(begin[1:], bounds[-1])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.code[data] * POWERS.up[: len(data)], dtype=np.uint64)])
        key = (sums[end] - sums[begin]) * POWERS.down[begin]
        key ^= key >> np.uint64(29)
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key += (end - begin).astype(np.uint64) + is_head * np.uint64(0x94D049BB133111EB)
        key ^= key >> np.uint64(32)
        return begin, end, key, counts


class Numbered(dict):
    """Gives each new string the next number and notes it."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, text: str) -> int:
        self[text] = number = len(self)
        self.fresh.append(text)
        return number

    def take(self) -> list[str]:
        fresh, self.fresh = self.fresh, []
        return fresh


class CutMemo:
    """Ids of texts by ids of their cuts; ``learn`` gives those of new cuts, None to go whole."""

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.learn, self.finder = learn, CutFinder()
        self.forget()

    def forget(self) -> None:
        self.table, self.ids, self.odd = KeyTable(), Ragged(), np.zeros(1 << 14, bool)

    def rows(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of each cut, and of each text the number of its cuts."""
        if self.ids.rows > CUT_MEMO:
            self.forget()
        data, bounds = text_bytes(array)
        begin, end, key, counts = self.finder(data, bounds)
        found = self.table.find(key)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            fresh, first, back = np.unique(key[missing], return_index=True, return_inverse=True)
            at, raw = missing[first], data.tobytes()
            cuts = [raw[a:b].decode() for a, b in zip(begin[at].tolist(), end[at].tolist())]
            ids, sizes, odd = self.learn(cuts)
            before = self.ids.rows
            self.ids.append(ids, sizes)
            self.odd = _room(self.odd, self.ids.rows)
            self.odd[before : self.ids.rows] = odd
            numbers = np.arange(before, self.ids.rows, dtype=np.int32)
            self.table.add(fresh, numbers)
            found[missing] = numbers[back]
        return found, counts


def text_bytes(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of an array without nulls, and their bounds."""
    array = array.cast(pa.large_string())
    bounds = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, 8 * array.offset)
    held = array.buffers()[2]
    data = np.frombuffer(held, np.uint8)[bounds[0] : bounds[-1]] if held else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


# Fixed rule: printable bytes stand for themselves, the others for characters from 256 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PLAIN}))}


class TextEncoder:
    """Encodes texts to arrays of ids; equal to ``encode(text, add_special_tokens=False)``."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.parts = regex.compile(_pattern(json.loads(self.tokenizer.to_str())["pre_tokenizer"])).findall
        added = self.tokenizer.get_added_tokens_decoder().values()
        special = regex.compile("|".join(regex.escape(t.content) for t in added) or r"(?!)")
        self.special, self.special_all = special.search, special.finditer
        self.pieces, self.piece_ids = Numbered(), Ragged()
        self.memo = CutMemo(self._learn)

    def forget(self) -> None:
        self.pieces, self.piece_ids = Numbered(), Ragged()
        self.memo.forget()
        POWERS.forget()

    def _normal(self, cuts: list[str]) -> list[str]:
        if not self.normalizer or not cuts:
            return cuts
        fence = f" {SEPARATOR} "
        return self.normalizer.normalize_str(fence.join(cuts)).split(fence)

    def piece(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        return [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(BYTE_CHARS))]

    def _learn(self, cuts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        odd = [not c.strip(" ") or c[-1].isspace() or SEPARATOR in c or self.special(c) is not None for c in cuts]
        if len(self.pieces) > PIECE_MEMO:
            self.pieces, self.piece_ids = Numbered(), Ragged()
        parts = iter(map(self.parts, self._normal([c for c, o in zip(cuts, odd) if not o])))
        rows = [() if o else list(map(self.pieces.__getitem__, next(parts))) for o in odd]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        rows = np.fromiter((r for row in rows for r in row), np.int64, int(counts.sum()))
        found = list(map(self.piece, self.pieces.take()))
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.piece_ids.append(np.fromiter((i for f in found for i in f), np.uint32, int(sizes.sum())), sizes)
        ends, last = np.concatenate([[0], np.cumsum(self.piece_ids.size[rows])]), np.cumsum(counts)
        return self.piece_ids.gather(rows), ends[last] - ends[last - counts], np.array(odd, bool)

    def encode_all(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each text."""
        rows, counts = self.memo.rows(array)
        last = np.cumsum(counts)
        ends = np.concatenate([[0], np.cumsum(self.memo.ids.size[rows])])
        sizes = ends[last] - ends[last - counts]
        odd = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(self.memo.odd[rows])])[np.concatenate([[0], last])]))
        ids = self.memo.ids.gather(rows)
        if not len(odd):
            return ids, sizes
        parts = np.split(ids, np.cumsum(sizes)[:-1])
        for i in odd.tolist():
            parts[i] = self.whole(array[i].as_py())
            sizes[i] = len(parts[i])
        return np.concatenate(parts), sizes

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _pattern(split: dict) -> str:
    """The expression by which a pre-tokenizer of a vocabulary file finds its pieces."""
    if split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]:
        return BYTE_LEVEL
    if split["type"] == "Sequence" and split["pretokenizers"][0]["type"] == "Split":
        first, *rest = split["pretokenizers"]
        if first["invert"] and first["behavior"] == "Removed" and [r["type"] for r in rest] == ["ByteLevel"]:
            return first["pattern"]["Regex"]
    raise ValueError("this pre-tokenizer is not known to cut at spaces")


def encoder(path: str) -> TextEncoder:
    """The encoder of this worker process for a vocabulary file."""
    if path not in _OPEN:
        _OPEN[path] = TextEncoder(path)
    return _OPEN[path]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file, on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)
