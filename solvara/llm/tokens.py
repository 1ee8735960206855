"""Text to token ids with a public byte-level BPE vocabulary, whole texts only."""

from __future__ import annotations

import itertools
import json
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from solvara.llm.textkit import utf8

#: Bytes of pieces and their ids that a worker keeps from task to task, at most.
CACHE_BYTES = 64 << 20
#: Bytes of text that are cut and looked up at a time, about: what is worked on stays in the processor's cache.
SLICE_BYTES = 1 << 19
#: Longest piece kept, as two numbers of 8 bytes.
KEPT_LENGTH = 16

# Classes of bytes. A byte of OTHER is never next to a cut but for one before white space.
SPACE, BREAK, LETTER, DIGIT, SIGN, QUOTE, OTHER = range(7)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[[0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = BREAK
_CLASS[0x20], _CLASS[0x27] = SPACE, QUOTE
#: Of two neighbouring classes (8 * first + second): 1, a cut between them, whatever follows; 2, a cut before both.
_CUTS = np.zeros(256, np.uint8)
for _a in (LETTER, DIGIT, SIGN, QUOTE):
    for _b in (SPACE, BREAK):
        _CUTS[8 * _a + _b] = 1  # a token never runs on into white space
        _CUTS[8 * _b + _a] = 2 + (_b == BREAK)  # the last of white space before a word stands apart, a space goes with the word
    for _b in (LETTER, DIGIT, SIGN, QUOTE):
        _CUTS[8 * _a + _b] = _a in (LETTER, DIGIT) and _b != _a or _a == SIGN and _b in (LETTER, DIGIT)


def through(table: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Each byte's entry in a table of 256 bytes."""
    return np.frombuffer(bytearray(data.tobytes().translate(table.tobytes())), np.uint8)


def piece_starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where pieces of UTF-8 texts start, so that a text's ids are those of its pieces, one after the other; and the bytes' classes.

    The vocabulary's pattern takes runs of letters, of digits or of other signs, each with one space before it, English
    contractions, and white space but for its last before a word. So a token always ends before white space, before the
    last white space in front of a word, and where letters, digits and signs meet. Cuts are made at those of these
    places that ASCII and Latin-1 letters show; none is made after an apostrophe, which may open a contraction, nor
    beside other characters. So a piece without apostrophes and others is one token of the pattern.
    """
    kind = through(_CLASS, data)
    lead = np.flatnonzero(data == 0xC3)  # opens the Latin-1 letters and two signs
    after = data[np.minimum(lead + 1, len(data) - 1)]
    letter = lead[(after & 0xC0 == 0x80) & (after != 0x97) & (after != 0xB7)]
    kind[letter] = kind[letter + 1] = LETTER
    flags = through(_CUTS, kind[:-1] << 3 | kind[1:])
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = flags & 1
    cut[:-2] |= flags > 1
    last = offsets[1:] - 1
    last = last[(last > 0) & (last > offsets[:-1])]
    cut[last] = flags[last - 1] & 1  # nothing follows the last byte of a text
    cut[offsets] = True
    cut[-1] = False
    return np.flatnonzero(cut), kind


def byte_symbols() -> dict[int, str]:
    """The vocabulary's symbol of each byte: printable Latin-1 characters stand for themselves, the rest follow from 256."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


#: NUL separates pieces, and stays.
_SYMBOLS = {b: c for b, c in byte_symbols().items() if b}
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
#: The first n bytes of 8.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Pieces:
    """Ids of pieces of up to ``KEPT_LENGTH`` bytes: an open hash table in numpy arrays, of bounded size.

    A piece is its bytes as two numbers, filled up with zeros; those with a zero byte aren't kept, so no two are alike.
    """

    def __init__(self) -> None:
        self.n = self.clock = 0
        self.low, self.high, self.start, self.size, self.used = (np.zeros(1 << 15, t) for t in (np.uint64, np.uint64, np.int64, np.int32, np.int32))
        self.ids, self.n_ids = np.zeros(1 << 16, np.uint32), 0
        self._place(1 << 16)

    def _slots(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mix = (low ^ (high * _FACTORS[0])) * _FACTORS[1]
        return ((mix ^ (mix >> np.uint64(29))) * _FACTORS[2] >> np.uint64(64 - self.bits)).astype(np.int64)

    def _place(self, slots: int) -> None:
        """Build the table anew with so many slots, a power of two."""
        self.bits, self.table = slots.bit_length() - 1, np.full(slots, -1, np.int32)
        self._insert(np.arange(self.n))

    def _insert(self, which: np.ndarray) -> None:
        at, mask = self._slots(self.low[which], self.high[which]), len(self.table) - 1
        while len(which):
            free = self.table[at] < 0
            self.table[at[free]] = which[free]  # of several that want a slot, one gets it
            left = self.table[at] != which
            which, at = which[left], at[left] + 1 & mask

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The place of each piece, -1 where it isn't known."""
        at, mask = self._slots(low, high), len(self.table) - 1
        out = self.table[at]
        other = np.flatnonzero((out >= 0) & ((self.low[out] != low) | (self.high[out] != high)))
        while len(other):
            at[other] = at[other] + 1 & mask
            got = self.table[at[other]]
            out[other] = got
            other = other[(got >= 0) & ((self.low[got] != low[other]) | (self.high[got] != high[other]))]
        return out

    def add(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add distinct pieces that aren't known, with their ids one after the other."""
        old, self.n = self.n, self.n + len(low)
        if self.n > len(self.low):
            self.low, self.high, self.start, self.size, self.used = (np.resize(x, 2 * self.n) for x in (self.low, self.high, self.start, self.size, self.used))
        if self.n_ids + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * (self.n_ids + len(ids)))
        new = slice(old, self.n)
        self.low[new], self.high[new], self.size[new], self.start[new] = low, high, sizes, self.n_ids + np.cumsum(sizes) - sizes
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.n_ids += len(ids)
        if 2 * self.n > len(self.table):
            self._place(1 << (3 * self.n).bit_length())
        else:
            self._insert(np.arange(old, self.n))

    def ids_of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces at these places, one after the other, and their number for each."""
        self.clock += 1
        self.used[at] = self.clock
        sizes = self.size[at]
        return self.ids[spread(self.start[at], sizes)], sizes

    def bounded(self, most: int) -> None:
        """Where there are more than ``most`` bytes, keep the half that was used last."""
        if 28 * len(self.low) + 4 * len(self.ids) + 4 * len(self.table) <= most:
            return
        keep = np.sort(np.argsort(-self.used[: self.n], kind="stable")[: self.n // 2])
        low, high, used, (ids, sizes) = self.low[keep], self.high[keep], self.used[keep], self.ids_of(keep)
        clock = self.clock
        self.__init__()
        self.add(low, high, ids, sizes)
        self.used[: self.n], self.clock = used, clock


class Encoder:
    """Ids of whole texts by the ``tokenizers`` library, as its plain call gives them without added special tokens.

    Each distinct piece (``piece_starts``) is encoded by the library once and then looked up. The pieces stay from task
    to task, ``CACHE_BYTES`` of them; beyond that, the less used go. A text that holds one of the file's special tokens
    is encoded by the plain call; with ``plain_specials`` such a token is ordinary text. A file with another
    pre-tokenizer or a normaliser is used by the plain call alone. Bytes that aren't UTF-8 count as U+FFFD.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        before = described.get("pre_tokenizer") or {}
        self.by_pieces = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not described.get("normalizer")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.special = [t["content"] for t in described.get("added_tokens", []) if not (plain_specials and t["special"])]
        self.known = Pieces()

    def _plain(self, texts: list[bytes]) -> list[np.ndarray]:
        decoded = [t.decode("utf-8", "replace") for t in texts]
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(decoded, add_special_tokens=False)]

    def _learned(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and their number for each; what isn't ``several`` tokens of the pattern need only be merged."""
        pieces = [data[s : s + n].tobytes() for s, n in zip(starts.tolist(), sizes.tolist())]
        merge, plain, single = self.tokenizer.model.tokenize, np.flatnonzero(several), np.flatnonzero(~several)
        out: list = [None] * len(pieces)
        if len(single):
            joined = b"\0".join([pieces[i] for i in single])
            for i, symbols in zip(single, joined.decode("latin-1").translate(_SYMBOLS).split("\0")):
                out[i] = [x.id for x in merge(symbols)]
        for i, ids in zip(plain, self._plain([pieces[i] for i in plain])):
            out[i] = ids
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out))

    def _looked_up(self, data: np.ndarray, starts: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of ``data``, one after the other, and their number for each."""
        size = np.diff(np.append(starts, len(data)))
        filled = np.concatenate([data, np.zeros(KEPT_LENGTH, np.uint8)])
        eights = np.ndarray(len(filled) - 7, "<u8", filled, strides=(1,))  # the 8 bytes from each on
        low = eights[starts] & _FIRST[np.minimum(size, 8)]
        high = np.zeros(len(starts), np.uint64)
        more = np.flatnonzero(size > 8)
        high[more] = eights[starts[more] + 8] & _FIRST[np.minimum(size[more], 16) - 8]
        apart = size > KEPT_LENGTH
        if not data.all():
            apart |= np.add.reduceat(data == 0, starts, dtype=np.int64) > 0
        at = self.known.find(low, high)
        new = np.flatnonzero((at < 0) | apart)
        if not len(new):
            return self.known.ids_of(at)
        several = np.maximum.reduceat(kind, starts) >= QUOTE
        keep = new[~apart[new]]
        if len(keep):
            order = keep[np.lexsort((low[keep], high[keep]))]
            head = np.append(True, (low[order][1:] != low[order][:-1]) | (high[order][1:] != high[order][:-1]))
            first = order[head]
            at[order] = self.known.n + np.cumsum(head) - 1
            self.known.add(low[first], high[first], *self._learned(data, starts[first], size[first], several[first]))
        if not apart.any():
            return self.known.ids_of(at)
        near, far = np.flatnonzero(~apart), np.flatnonzero(apart)
        ids, sizes = self.known.ids_of(at[near])
        own, own_sizes = self._learned(data, starts[far], size[far], several[far])
        total = np.zeros(len(starts), np.int64)
        total[near], total[far] = sizes, own_sizes
        out, begin = np.empty(total.sum(), np.uint32), np.cumsum(total) - total
        out[spread(begin[near], sizes)] = ids
        out[spread(begin[far], own_sizes)] = own
        return out, total

    def _by_pieces(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        starts, kind = piece_starts(data, offsets)
        ids, sizes = self._looked_up(data, starts, kind)
        self.known.bounded(CACHE_BYTES)
        return ids, np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one text after the other, and each text's range of them; nulls are empty."""
        whole = np.full(len(column), not self.by_pieces)
        for token in self.special:
            whole |= np.asarray(pc.fill_null(pc.match_substring(column, token), False))
        data, offsets = utf8(column)
        ids, sizes, row = [np.zeros(0, np.uint32)], [], 0
        plain = np.append(np.flatnonzero(whole), len(column))
        while row < len(column):
            if whole[row]:
                own = self._plain([data[offsets[row] : offsets[row + 1]].tobytes()])
                ids += own
                sizes.append([len(own[0])])
                row += 1
                continue
            end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
            end = min(end, int(plain[np.searchsorted(plain, row)]))
            got = self._by_pieces(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
            ids.append(got[0])
            sizes.append(got[1])
            row = end
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def encoder(path: str, plain_specials: bool = False) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    return Encoder(path, plain_specials)
