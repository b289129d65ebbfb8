"""Token ids by the ``tokenizers`` library, with each distinct pre-token encoded once per worker.

Texts are cut into the pre-tokens of the vocabulary by NumPy operations over their bytes, with the rules of the two
patterns in ``SPLIT``. A pre-token is looked up in a table by a 64-bit hash and its spelling is compared byte
by byte; a new one goes to the library's model. This covers printable ASCII, tab, line ends and the
Latin letters of two bytes from U+00C0 to U+024F that keep their class in lower case. A text with anything
else, with the content of an added token, or with a hash that two spellings share is encoded whole by
the library. Very long texts are cut at blanks between two other characters, where pre-tokens always end.
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The pre-tokenizers' patterns as the vocabularies' files have them, by whether a token keeps the blank in front.
SPLIT = {
    False: r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",  # over the text in lower case
    True: r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
}
#: What may follow an apostrophe as a pre-token of its own, by length.
_CLITICS = {1: (b"s", b"t", b"m", b"d"), 2: (b"re", b"ve", b"ll")}
#: Distinct pre-tokens that a worker remembers, about 60 bytes each; beyond it all are forgotten. Slots of their table.
REMEMBERED, SLOTS = 600_000, 21
#: Bytes of text handled at once.
RUN = 1 << 19
_ENCODERS: dict[tuple[str, bool], "Encoder"] = {}

_SPACE, _LETTER, _DIGIT, _SIGN, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _SIGN
_CLASS[[9, 10, 13, 32]] = _SPACE
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[128:192] = _CLASS[0xC3:0xCA] = _LETTER  # further bytes, and first bytes of U+00C0 to U+027F
_RNG = np.random.default_rng(20240301)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0xD1342543DE82EF95
_UP, _DOWN = (np.concatenate([[np.uint64(1)], np.full(RUN + 8192, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str, blank: bool) -> "Encoder":
    """This worker's encoder of a vocabulary (a path, or a public file's name); blank: pre-tokens keep the blank in front."""
    key = (name, blank)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(name, blank)
    return _ENCODERS[key]


def release() -> None:
    """Forgets all pre-tokens; called when a worker goes on to an operator that needs none."""
    for held in _ENCODERS.values():
        if held.table is not None:
            held.table = None
            trim()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use: itself, or one from 256 on in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices first[k], first[k] + 1, ... of size[k] each, one after another."""
    upto = np.cumsum(size)
    return np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(first - (upto - size), size)


class _Buffer:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def extend(self, more) -> None:
        if self.n + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(max(self.n, len(more)), self.data.dtype)])
        self.data[self.n : self.n + len(more)] = more
        self.n += len(more)


class _Table:
    """Spellings and ids of pre-tokens by hash, open addressing over arrays; entry k is spelt and encoded by what lies between ends k and k + 1."""

    def __init__(self):
        self.keys, self.entry = np.zeros(1 << SLOTS, np.uint64), np.zeros(1 << SLOTS, np.int32)
        self.spelt, self.ids = _Buffer(np.uint8), _Buffer(np.int32)
        self.spelt_ends, self.id_ends = _Buffer(np.int64), _Buffer(np.int64)
        self.spelt_ends.extend([0]), self.id_ends.extend([0])

    def __len__(self) -> int:
        return self.id_ends.n - 1

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        slot, out = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64), np.full(len(hashes), -1, np.int64)
        rows = np.arange(len(hashes))
        while len(rows):
            key = self.keys[slot]
            hit = key == hashes[rows]
            out[rows[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            rows, slot = rows[on], (slot[on] + 1) & ((1 << SLOTS) - 1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Places new hashes, all different; their entries are the next ones in order."""
        slot, entry = (hashes >> np.uint64(64 - SLOTS)).astype(np.int64), np.arange(len(self), len(self) + len(hashes), dtype=np.int32)
        while len(slot):
            free = np.flatnonzero(self.keys[slot] == 0)
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.entry[slot[put]] = hashes[put], entry[put]
            rest = np.ones(len(slot), bool)
            rest[put] = False
            hashes, entry, slot = hashes[rest], entry[rest], (slot[rest] + 1) & ((1 << SLOTS) - 1)


class Encoder:
    def __init__(self, name: str, blank: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(name if "/" in name else vocabulary(name))
        added = self.model.get_added_tokens_decoder().values()
        #: fold: some are looked for in the normalised text, so any case may be one
        self.fold = any(x.normalized for x in added)
        self.added = [(x.content.lower() if self.fold else x.content).encode() for x in added]
        self.size, self.blank = self.model.get_vocab_size(), blank
        #: the smallest type that holds every id
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.letters = dict(enumerate(byte_letters()))
        self.raw = self.model.model.tokenize
        self.table: _Table | None = None

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a string column one after another, the end of each text's ids); null has none."""
        column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).fill_null("").cast(pa.large_string())
        if not len(column):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        data, offsets = _bytes(column)
        odd = self._odd(data, offsets)
        if odd.any():
            data, offsets = _bytes(pc.if_else(pa.array(odd), "", column).cast(pa.large_string()))
        ids, ends, clash = self._plain(data, offsets)
        odd |= clash
        if not odd.any():
            return ids, ends
        rows = np.flatnonzero(odd)
        parts = np.split(ids, ends[:-1])
        for k in rows.tolist():
            parts[k] = np.array(self.model.encode_batch_fast([column[k].as_py()], add_special_tokens=False)[0].ids, self.kind)
        return np.concatenate(parts), np.cumsum([len(x) for x in parts])

    def _odd(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Which texts the library has to encode whole."""
        places = [np.flatnonzero(_CLASS[data] == _ODD)]
        lead = np.flatnonzero((data >= 0xC3) & (data < 0xCA))
        pair = data[lead].astype(np.int64) << 8 | data[np.minimum(lead + 1, max(len(data) - 1, 0))]
        # the signs of multiplication and division, a capital that lower case spells with a mark, and what follows U+024F
        places.append(lead[(pair == 0xC397) | (pair == 0xC3B7) | (pair == 0xC4B0) | (pair > 0xC98F)])
        raw = data.tobytes()
        raw = raw.lower() if self.fold else raw
        for content in self.added:
            at = raw.find(content)
            while at >= 0:
                places.append(np.array([at]))
                at = raw.find(content, at + 1)
        at = np.concatenate(places)
        out = np.zeros(len(offsets) - 1, bool)
        out[np.searchsorted(offsets, at, "right") - 1] = True
        return out

    def _plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, the end of each text's ids, whether a text has a hash that two spellings share)."""
        ids, counts, clash = [], np.zeros(len(offsets) - 1, np.int64), np.zeros(len(offsets) - 1, bool)
        for a, b in _runs(data, offsets):
            if self.table is None or len(self.table) > REMEMBERED:
                self.table = None
                self.table = _Table()
            part = data[a:b]
            if not self.blank:
                part = _lower(part)
            edges = offsets[(offsets >= a) & (offsets <= b)] - a
            starts, ends, kinds = self._cut(part, edges)
            if not len(starts):
                continue
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(_BYTE[part] * _up(len(part)), out=total[1:])
            hashes = (total[ends] - total[starts]) * _down(len(part))[starts]
            hashes ^= hashes >> np.uint64(32)
            hashes = hashes * np.uint64(0xD6E8FEB86659FD93) | np.uint64(1)
            entry = self.table.find(hashes)
            new = np.flatnonzero(entry < 0)
            if len(new):
                seen, first = np.unique(hashes[new], return_index=True)
                self._learn(part, starts[new[first]], ends[new[first]], seen)
                entry[new] = self.table.find(hashes[new])
            t = self.table
            size = ends - starts
            spelt = t.spelt_ends.data[entry]
            same = t.spelt_ends.data[entry + 1] - spelt == size
            told = part if self.blank else part[kinds != _SPACE]
            if same.all():
                wrong = np.flatnonzero(t.spelt.data[_ragged(spelt, size)] != told)
                same[np.searchsorted(np.cumsum(size), wrong, "right")] = False
            owner = np.searchsorted(offsets, a + starts, "right") - 1
            clash[owner[~same]] = True
            first, many = t.id_ends.data[entry], t.id_ends.data[entry + 1] - t.id_ends.data[entry]
            ids.append(t.ids.data[_ragged(first, many)].astype(self.kind))
            counts += np.bincount(owner, many, len(counts)).astype(np.int64)
        return np.concatenate(ids) if ids else np.zeros(0, self.kind), np.cumsum(counts), clash

    def _cut(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends) of the pre-tokens of texts that begin at ``edges``, and each byte's class."""
        n, kinds = len(data), _CLASS[data]
        first = np.zeros(n + 1, bool)
        first[edges] = first[0] = True
        space = kinds == _SPACE
        before = np.empty(n, np.uint8)
        before[0], before[1:] = _ODD, kinds[:-1]
        start = (kinds != before) | first[:-1]
        if self.blank:
            # the last space before something else stands alone, or, if a blank, belongs to what follows
            after = np.append(~space[1:], False) & ~first[1:]
            start |= space & after
            absorbed = np.zeros(n, bool)
            absorbed[1:] = ~space[1:] & (data[:-1] == 32)
            start &= ~absorbed | first[:-1]
        else:
            start |= kinds == _DIGIT
        # an apostrophe that begins a pre-token, and certain letters after it, are one
        mark = np.flatnonzero((data == 39) & start)
        if len(mark):
            last = np.append(edges, n)[np.searchsorted(np.append(edges, n), mark, "right")]
            for long, tails in _CLITICS.items():
                at = mark[mark + long < last]
                hit = np.zeros(len(at), bool)
                for tail in tails:
                    hit |= np.all([data[at + 1 + k] == c for k, c in enumerate(tail)], axis=0)
                at = at[hit]
                start[at + 1] = False
                on = at + 1 + long
                on = on[on < n]
                start[on[(kinds[on] == _LETTER)]] = True
        if self.blank:
            starts = np.flatnonzero(start)
            return starts, np.append(starts[1:], n), kinds
        starts = np.flatnonzero(start & ~space)
        stop = np.flatnonzero(start | (space & ~(before == _SPACE)))
        ends = np.append(stop, n)[np.searchsorted(stop, starts, "right")]
        return starts, ends, kinds

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        t, raw, letters = self.table, self.raw, self.letters
        whole, ids, sizes = data.tobytes().decode("latin-1"), [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            word = whole[a:b]
            if not (word.isascii() and word.isalnum()):
                if not self.blank and not word.isascii():
                    word = word.encode("latin-1").decode().lower().encode().decode("latin-1")
                word = word.translate(letters)
            got = [x.id for x in raw(word)]
            ids += got
            sizes.append(len(got))
        t.add(hashes)
        size = ends - starts
        t.spelt.extend(data[_ragged(starts, size)])
        t.spelt_ends.extend(np.cumsum(size) + t.spelt_ends.data[t.spelt_ends.n - 1])
        t.ids.extend(ids)
        t.id_ends.extend(np.cumsum(sizes) + t.id_ends.data[t.id_ends.n - 1])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string column, and where its texts begin and end in them."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of U+00C0 to U+00DE; other letters follow when they are learnt."""
    out = np.where((data >= 65) & (data < 91), data + 32, data).astype(np.uint8)
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[data[at] < 0x9F]
    out[at] += 32
    return out


def _runs(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``RUN`` bytes of whole texts; a longer text is cut at blanks between two other characters."""
    a, end = int(offsets[0]), int(offsets[-1])
    while a < end:
        if end - a <= RUN:
            b = end
        else:
            b = int(offsets[np.searchsorted(offsets, a + RUN, "right") - 1])
            if b <= a:
                stop = int(offsets[np.searchsorted(offsets, a, "right")])
                b = _blank(data, a + RUN, min(stop, a + RUN + 8000)) or _blank(data, a + RUN, stop) or stop
        yield a, b
        a = b


def _blank(data: np.ndarray, a: int, b: int) -> int | None:
    """The first blank from a to b between two characters that are no space."""
    part = _CLASS[data[a - 1 : b]] == _SPACE
    at = np.flatnonzero((data[a : b - 1] == 32) & ~part[:-2] & ~part[2:]) if b - a > 1 else part[:0]
    return a + int(at[0]) if len(at) else None


def _up(n: int) -> np.ndarray:
    return _UP[:n] if n <= len(_UP) else np.concatenate([[np.uint64(1)], np.full(n - 1, _BASE, np.uint64)]).cumprod(dtype=np.uint64)


def _down(n: int) -> np.ndarray:
    return _DOWN[:n] if n <= len(_DOWN) else np.concatenate([[np.uint64(1)], np.full(n - 1, pow(_BASE, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)
