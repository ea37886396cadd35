"""Token ids of many texts at once, for a tokenizer of word pieces.

The tokenizer drops white space and never joins what stands on either side of it, and its expression
cuts ASCII and Western European text by classes of letters, digits and other characters.  So a text's
ids are those of its pieces in a row.  Pieces are found over whole buffers of bytes, and the ids of
those met before are read off a table.
"""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from .common import mix

#: Pieces whose ids a worker remembers at most (about 60 bytes each), and the bytes of text that it
#: encodes at once.  Smaller numbers save memory and cost time.
REMEMBER, ENCODE = 400_000, 1_000_000

# What a tokenizer file must say for its pieces to be those found here.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_END_OF_WORD = "</w>"

_BLANK, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[[10, 32]] = _BLANK
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _CLASS[65:91] = _LETTER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)


def known_kind(path: str) -> bool:
    """Whether the file describes a tokenizer whose pieces this module finds."""
    said = json.loads(Path(path).read_text())
    steps = lambda x, name: [(s["type"], s) for s in (x or {}).get(name, [])]
    normal, before, model = steps(said["normalizer"], "normalizers"), steps(said["pre_tokenizer"], "pretokenizers"), said["model"]
    return (
        [n for n, _ in normal] == ["NFC", "Replace", "Lowercase"] and normal[1][1]["pattern"] == {"Regex": r"\s+"} and normal[1][1]["content"] == " "
        and [n for n, _ in before] == ["Split", "ByteLevel"] and before[0][1]["pattern"] == {"Regex": _SPLIT} and before[0][1]["invert"] and before[0][1]["behavior"] == "Removed"
        and not before[1][1]["add_prefix_space"] and not before[1][1]["use_regex"]
        and model["type"] == "BPE" and model["end_of_word_suffix"] == _END_OF_WORD and not model["dropout"] and not model["ignore_merges"] and not model["unk_token"]
        and all("<|" in t["content"] and " " not in t["content"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in said["added_tokens"])
    )


class Encoder:
    """Ids of texts, the same as the tokenizer's own without its special tokens at the ends.

    Chunks between blanks with any other character than ASCII and Western European letters, digits
    and marks, or with the beginning of a special token, go through the whole tokenizer; so do whole
    texts if the file is of another kind.
    """

    def __init__(self, path: str, remember: int = REMEMBER, by_pieces: bool | None = None):
        """by_pieces: what `known_kind` says of the file, if it was asked already."""
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.by_pieces = known_kind(path) if by_pieces is None else by_pieces
        if not self.by_pieces:
            return
        self.remember = remember
        self.model = Tokenizer(self.whole.model)
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab(with_added_tokens=False)
        self.last = np.zeros(1 + max(vocabulary.values()), bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith(_END_OF_WORD)]] = True
        self.powers = self.inverse = np.ones(1, np.uint64)
        self._forget()

    def _forget(self) -> None:
        """The table: hashes in an open-addressed array, and for each piece its bytes and its ids."""
        self.bits = max(10, int(2 * self.remember).bit_length())
        self.slots, self.piece_at = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        self.n = 0
        self.text = np.empty(0, np.uint8)
        self.ids = np.empty(0, "<u4")
        self.text_at, self.ids_at = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _grow(self, n: int) -> None:
        base, inverse = np.full(n, _MULTIPLIER, np.uint64), np.full(n, pow(int(_MULTIPLIER), -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        with np.errstate(over="ignore"):
            self.powers, self.inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)

    # -- pieces ---------------------------------------------------------------------------------
    @staticmethod
    def pieces(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bytes in lower case, first, after, odd): the pieces of a buffer that begins and ends with a
        blank; an odd one is a whole chunk in its own case."""
        kind, low = _CLASS[raw], _LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3)
        follow = raw[lead + 1]
        letter = (follow != 0x97) & (follow != 0xB7)  # the signs of multiplication and division
        kind[lead[letter]] = kind[lead[letter] + 1] = _LETTER
        upper = lead[letter & (follow < 0x9F)] + 1
        low[upper] += 0x20
        strange = kind == _ODD
        strange[np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124))] = True
        if strange.any():
            chunk = np.cumsum(kind == _BLANK)
            of = np.zeros(chunk[-1] + 1, bool)
            of[chunk[strange]] = True
            inside = of[chunk] & (kind != _BLANK)
            kind[inside], low[inside] = _ODD, raw[inside]
        change = np.empty(len(raw), bool)
        change[0], change[1:] = False, kind[1:] != kind[:-1]
        change |= kind == _DIGIT
        # an apostrophe that begins a piece takes the ending of a contraction with it
        mark = np.flatnonzero((low == 39) & change & (kind == _OTHER))
        if len(mark):
            a, b = low[mark + 1], low[np.minimum(mark + 2, len(low) - 1)]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
            joined = mark[one | two]
            after = joined + np.where(one[one | two], 2, 3)
            letter = kind[joined + 1] == _LETTER
            joined, after = joined[letter], after[letter]
            change[joined + 1] = False
            change[after] |= kind[after] == _LETTER
        at = np.flatnonzero(change)
        first = np.flatnonzero(kind[at] != _BLANK)
        return low, at[first], at[first + 1], kind[at[first]] == _ODD

    # -- the table ------------------------------------------------------------------------------
    def _places(self, h: np.ndarray) -> np.ndarray:
        """Numbers of the pieces with the hashes h; -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        open_, slot = np.arange(len(h)), (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(open_):
            held = self.slots[slot]
            same = held == h[open_]
            out[open_[same]] = self.piece_at[slot[same]]
            on = ~same & (held != 0)
            open_, slot = open_[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _insert(self, h: np.ndarray, pieces: list[bytes], odd: bool) -> None:
        ids, sizes = self._odd_ids(pieces) if odd else self._ids(pieces)
        after = lambda at, sizes: np.concatenate([at, at[-1] + np.cumsum(sizes)])
        self.text, self.ids = np.concatenate([self.text, np.frombuffer(b"".join(pieces), np.uint8)]), np.concatenate([self.ids, ids])
        self.text_at, self.ids_at = after(self.text_at, [len(p) for p in pieces]), after(self.ids_at, sizes)
        number = np.arange(self.n, self.n + len(h))
        self.n += len(h)
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.slots[slot] == 0
            _, one = np.unique(slot, return_index=True)  # one of those that want the same slot
            taken = np.zeros(len(h), bool)
            taken[one] = True
            taken &= free
            self.slots[slot[taken]], self.piece_at[slot[taken]] = h[taken], number[taken]
            h, number, slot = h[~taken], number[~taken], (slot[~taken] + 1) & ((1 << self.bits) - 1)

    def _odd_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, list[int]]:
        found = [x.ids for x in self.whole.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]
        return np.array([i for x in found for i in x], "<u4"), [len(x) for x in found]

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """New pieces go straight to the tokenizer's model, many at once: a piece's last id, and no
        other, stands for a token with the mark of a word's end."""
        ids, sizes = [], []
        for s in range(0, len(pieces), 500):
            some = pieces[s : s + 500]
            ids.append(np.array(self.model.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, "<u4"))
            ends = np.flatnonzero(self.last[ids[-1]])
            assert len(ends) == len(some)
            sizes.append(np.diff(ends, prepend=-1))
        return np.concatenate(ids), np.concatenate(sizes)

    # -- texts ----------------------------------------------------------------------------------
    def encode(self, raws: list[bytes]) -> list[np.ndarray]:
        """The ids of each text (UTF-8), little-endian unsigned 32-bit numbers."""
        if not self.by_pieces:
            return [np.array(x.ids, "<u4") for x in self.whole.encode_batch_fast([r.decode() for r in raws], add_special_tokens=False)]
        raw = np.frombuffer(b"\n".join([b"", *raws, b""]), np.uint8)
        low, first, after, odd = self.pieces(raw)
        if len(raw) > len(self.powers):
            self._grow(2 * len(raw))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_VALUES[low] * self.powers[: len(raw)], out=sums[1:])
            h = mix((sums[after] - sums[first]) * self.inverse[first] + odd) | np.uint64(1)
        place = self._places(h)
        new = np.flatnonzero(place < 0)
        if len(new):
            keys, one = np.unique(h[new], return_index=True)
            if self.n + len(keys) > self.remember:
                self._forget()
                keys, one = np.unique(h, return_index=True)
                new = np.arange(len(h))
                if len(keys) > self.remember:
                    self.remember = len(keys)
                    self._forget()
            i, data = new[one], low.tobytes()
            for kind in (False, True):
                some = odd[i] == kind
                if some.any():
                    self._insert(keys[some], [data[a:b] for a, b in zip(first[i[some]].tolist(), after[i[some]].tolist())], kind)
            place[new] = self._places(h[new])
        wrong = self._differing(low, first, after, place)
        size = np.diff(self.ids_at)[place]
        ids = self.ids[_ranges(self.ids_at[place], size)]
        starts = np.concatenate([[0], np.cumsum(size)])
        ends = np.cumsum([len(r) + 1 for r in raws])  # each text's closing blank
        cut = starts[np.searchsorted(first, np.concatenate([[0], ends]))].tolist()
        out = [ids[a:b] for a, b in zip(cut, cut[1:])]
        for d in np.unique(np.searchsorted(ends, first[wrong], side="right")).tolist():
            out[d] = np.array(self.whole.encode(raws[d].decode(), add_special_tokens=False).ids, "<u4")
        return out

    def _differing(self, low: np.ndarray, first: np.ndarray, after: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Pieces that share their hash with another one, which no text is likely to have."""
        size = after - first
        wrong = size != np.diff(self.text_at)[place]
        same = np.flatnonzero(~wrong)
        differ = low[_ranges(first[same], size[same])] != self.text[_ranges(self.text_at[place[same]], size[same])]
        if differ.any():
            wrong[same[np.searchsorted(np.cumsum(size[same]), np.flatnonzero(differ), side="right")]] = True
        return np.flatnonzero(wrong)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] numbers, then those of the next."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(start - (ends - size), size) + np.arange(total)
