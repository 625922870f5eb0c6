"""Byte-level BPE ids of whole texts by the tokenizers library, with a memo of pieces between safe cuts.

The vocabulary's pre-tokenizer always splits before white space that follows something else, after a lone newline, and between an
ASCII letter or digit and a full stop or comma. Texts are cut there as bytes, whole batches at a time; each distinct piece is encoded once by
the library and kept by its 64-bit hash, and a batch's ids are put together from the memo by array operations. A text
with a special token's string or other Unicode white space is a single piece.
"""

from __future__ import annotations

import numpy as np

from .common import Text, hashes_of

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK = np.zeros(256, bool)
_MARK[[0x2C, 0x2E]] = True
#: First bytes of other white space (U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000) and C0 separators.
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_WIDE = {0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000}
SLICE_BYTES = 2_000_000


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts. The memo starts anew once it holds `memo` pieces or `most` ids, so its memory is bounded."""

    def __init__(self, path: str, memo: int = 1_500_000, most: int = 16_000_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.most = Tokenizer.from_file(path), memo, most
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self._reset()

    def _reset(self) -> None:
        slots = 1 << 16
        self.keys, self.entry = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        # entry 0 is the end id
        self.flat, self.end, self.used = np.zeros(1 << 18, np.uint32), 1, 1
        self.first, self.count = np.zeros(1 << 15, np.int32), np.zeros(1 << 15, np.int32)
        self.count[0] = 1

    def _odd(self, text: Text) -> np.ndarray:
        """Which texts are a single piece."""
        data, offsets = text
        at = np.flatnonzero(_LEAD[data])
        pad = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int32)
        a, b, c = pad[at], pad[at + 1] & 0x3F, pad[at + 2] & 0x3F
        code = np.where(a < 0x20, 0x85, np.where(a == 0xC2, (a & 0x1F) << 6 | b, (a & 0x0F) << 12 | b << 6 | c))
        at = at[np.isin(code, list(_WIDE))]
        odd = np.zeros(len(offsets) - 1, bool)
        odd[np.searchsorted(offsets, at, "right") - 1] = True
        raw = None
        for word in self.special:
            if len(data) >= len(word) and np.any((data[:-1] == word[0]) & (data[1:] == word[1])):
                raw = raw or data.tobytes()
                place = raw.find(word)
                while place >= 0:
                    odd[np.searchsorted(offsets, place, "right") - 1] = True
                    place = raw.find(word, place + 1)
        return odd

    def _pieces(self, text: Text) -> tuple[np.ndarray, np.ndarray]:
        """Where pieces begin, and the first piece of each text (n + 1 entries)."""
        data, offsets = text
        space = _SPACE[data]
        cut = np.empty(len(data), bool)
        cut[0] = True
        cut[1:] = (space[1:] & ~space[:-1]) | (_MARK[data[1:]] & _ALNUM[data[:-1]])
        lone = np.flatnonzero(data == 0x0A)
        lone = lone[lone + 1 < len(data)]
        cut[lone[cut[lone] & ~space[lone + 1]] + 1] = True
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        # a lone newline at a text's start is a cut as well
        own = heads[(data[heads] == 0x0A) & (heads + 1 < len(data))]
        cut[own[~space[own + 1]] + 1] = True
        cut[heads] = True
        odd = self._odd(text)
        for i in np.flatnonzero(odd).tolist():
            cut[offsets[i] + 1 : offsets[i + 1]] = False
        start = np.flatnonzero(cut)
        return start, np.searchsorted(start, offsets)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of hashes, -1 where there is none."""
        mask = len(self.keys) - 1
        out = np.full(len(keys), -1, np.int32)
        slot = (keys & np.uint64(mask)).astype(np.int64)
        got = self.keys[slot]
        same = got == keys
        out[same] = self.entry[slot[same]]
        left = np.flatnonzero(~same & (got != 0))
        while len(left):
            slot[left] = (slot[left] + 1) & mask
            got = self.keys[slot[left]]
            same = got == keys[left]
            out[left[same]] = self.entry[slot[left[same]]]
            left = left[~same & (got != 0)]
        return out

    def _put(self, keys: np.ndarray, entries: np.ndarray) -> None:
        """New, distinct hashes."""
        if 2 * (self.used + len(keys)) > len(self.keys):
            size = len(self.keys)
            while 2 * (self.used + len(keys)) > size:
                size *= 2
            old = self.keys != 0
            keys, entries = np.concatenate([self.keys[old], keys]), np.concatenate([self.entry[old], entries])
            self.keys, self.entry = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        mask = len(self.keys) - 1
        slot, left = (keys & np.uint64(mask)).astype(np.int64), np.arange(len(keys))
        while len(left):
            at = slot[left]
            free = self.keys[at] == 0
            self.keys[at[free]] = keys[left[free]]
            mine = free & (self.keys[at] == keys[left])
            self.entry[at[mine]] = entries[left[mine]]
            left = left[~mine]
            slot[left] = (slot[left] + 1) & mask

    def _learn(self, keys: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Encodes new pieces; words go to the library as one text, a newline (a token of its own) between two."""
        raw = data.tobytes()
        pieces = [raw[a:b].decode() for a, b in zip(start.tolist(), end.tolist())]
        blanks = np.concatenate([[0], np.cumsum(_SPACE[data])])
        spaces = blanks[end] - blanks[start]
        plain = (spaces == 0) | ((spaces == 1) & (data[start] == 0x20) & (end - start > 1))
        plain &= end - start < 500  # a long piece is encoded by itself
        for which in (np.flatnonzero(plain), np.flatnonzero(~plain)):
            for i in range(0, len(which), 8192):
                some = which[i : i + 8192]
                texts = [pieces[k] for k in some.tolist()]
                ids, n = self._joined(texts) if plain[some[0]] else self._each(texts)
                self._keep(keys[some], ids, n)

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        cuts = np.flatnonzero(ids == self.newline)
        if len(cuts) != len(pieces) - 1:
            return self._each(pieces)
        return np.delete(ids, cuts), np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        each = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        n = np.array([len(x) for x in each])
        return np.fromiter((i for x in each for i in x), np.uint32, int(n.sum())), n

    def _keep(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        to, last = self.end + len(ids), self.used + len(n)
        while to > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while last > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.count))
        self.flat[self.end : to] = ids
        self.first[self.used : last], self.count[self.used : last] = self.end + np.cumsum(n) - n, n
        self._put(keys, np.arange(self.used, last, dtype=np.int32))
        self.end, self.used = to, last

    def encode(self, text: Text, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32), each text's followed by end_id if one is given, and the offsets of the texts in them (n + 1 entries)."""
        if self.used > self.memo or self.end > self.most:
            self._reset()
        data, offsets = text
        if len(data):
            start, first = self._pieces(text)
            end = np.append(start[1:], len(data))
            keys = hashes_of(data, start, end)
            keys[keys == 0] = 1
            index = self._find(keys)
            missing = np.flatnonzero(index < 0)
            if len(missing):
                fresh, where, back = np.unique(keys[missing], return_index=True, return_inverse=True)
                where = missing[np.sort(where)]
                self._learn(keys[where], data, start[where], end[where])
                index[missing] = self._find(keys[missing])
        else:
            index, first = np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        if end_id is not None:
            self.flat[0] = end_id
            index = np.insert(index, first[1:], 0)
            first = first + np.arange(len(first))
        begin, n = self.first[index], self.count[index]
        ends = np.cumsum(n, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if total < 2**31 else np.int64
        ids = self.flat[np.repeat((begin - ends + n).astype(kind), n) + np.arange(total, dtype=kind)]
        return ids, np.concatenate([[0], ends])[first]


_encoders: dict[str, Encoder] = {}


def encoder(path: str, memo: int = 1_500_000) -> Encoder:
    """One per worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, memo)
    return _encoders[path]


def release() -> None:
    """Gives the memos' memory back to the system."""
    if _encoders:
        import ctypes
        import gc

        _encoders.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library keeps it for this process
            pass
