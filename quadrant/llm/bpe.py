"""Byte-pair encoding of many plain words at once, for a tokenizer file whose words never join.

The tokenizers library spends some 25 microseconds on each new word. For words of letters this module applies the
file's merges to thousands of words at a time in numpy, one merge a word and round, the lowest rank first and the
leftmost of equals, as the library does. Whatever isn't a word of letters in normal form, with ASCII full stops and the
like behind it, is left to the library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that may follow a word: each run of them is a token sequence of its own in the file's pattern.
AFTER = ".,!?;:#$%&*"
#: Letters whose lower case depends on what stands around them, or is more than one letter.
ODD = "Σİ"
LONGEST, MARKS = 48, 8  # bytes
SLOT_BITS, MULTIPLIERS = 18, (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def byte_letters() -> dict[int, str]:
    """The printable letter of each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Merges:
    def __init__(self, model: dict):
        vocabulary, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        letters = byte_letters()
        self.inner = np.array([vocabulary[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([vocabulary[letters[b] + model["end_of_word_suffix"]] for b in range(256)], np.int64)
        keys = np.array([vocabulary[a] << 20 | vocabulary[b] for a, b in pairs], np.int64)
        self.keys = keys
        # two tables of slots by two hashes; a pair that finds both taken goes to the sorted rest
        self.slots, place = np.zeros((2, 1 << SLOT_BITS), np.int32), np.arange(len(keys))
        for k in range(2):
            slot = self._slot(keys[place], k)
            _, first = np.unique(slot, return_index=True)
            self.slots[k, slot[first]] = place[first] + 1
            place = np.setdiff1d(place, place[first])
        order = np.argsort(keys[place])
        self.rest, self.rest_rank = keys[place][order], place[order]
        self.merged = np.array([vocabulary[a + b] for a, b in pairs], np.int64)

    @classmethod
    def of(cls, tokenizer) -> Merges | None:
        """From a tokenizer of the kind that encode() is right for, else None."""
        spec = json.loads(tokenizer.to_str())
        model, steps = spec["model"], (spec.get("normalizer") or {}).get("normalizers", [])
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        fits = model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout") and not model.get("ignore_merges") and not model.get("continuing_subword_prefix")
        fits = fits and [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split.get("invert") and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in split["pattern"].get("Regex", "")
        return cls(model) if fits else None

    @staticmethod
    def _slot(key: np.ndarray, k: int) -> np.ndarray:
        return (key.astype(np.uint64) * MULTIPLIERS[k]) >> np.uint64(64 - SLOT_BITS)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair among the merges, their number for none."""
        key, never = left << 20 | right, len(self.keys)
        at = self.slots[0][self._slot(key, 0)]
        found = np.where((at > 0) & (self.keys[at - 1] == key), at - 1, never).astype(np.int64)
        late = np.nonzero(found == never)  # taken by another pair, or none
        at = self.slots[1][self._slot(key[late], 1)]
        found[late] = np.where((at > 0) & (self.keys[at - 1] == key[late]), at - 1, never)
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, key), len(self.rest) - 1)
            hit = self.rest[at] == key
            found[hit] = self.rest_rank[at[hit]]
        return found

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words (lower-case letters, of at most LONGEST bytes in UTF-8), one after another, and how many each has."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw, size = np.frombuffer(words.buffers()[2], np.uint8), np.diff(offsets)
        order = np.argsort(size, kind="stable")
        found, count = [], np.empty(len(words), np.int64)
        for part in np.array_split(order, max(1, len(words) // 8192)):
            ids, left = self._encode(raw, offsets[part], size[part])
            found.append(ids)
            count[part] = left
        # back from the order by size
        flat, n = np.concatenate(found), count[order]
        start = np.empty(len(words), np.int64)
        start[order] = np.cumsum(n) - n
        stop = np.cumsum(count)
        return flat[np.repeat(start - (stop - count), count) + np.arange(len(flat))], count

    def _encode(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(size), int(size.max(initial=1))
        raw = flat[np.minimum(start[:, None] + np.arange(width), len(flat) - 1)]
        ids = self.inner[raw]
        rows = np.arange(n)
        ids[rows, size - 1] = self.final[raw[rows, size - 1]]
        never, column = len(self.keys), np.arange(width)
        left = size.copy()
        ranks = np.full((n, width), never, np.int64)
        if width > 1:
            ranks[:, :-1] = self._ranks(ids[:, :-1], ids[:, 1:])
        ranks[column[None, :] >= (left - 1)[:, None]] = never
        live = rows
        while len(live):
            at = ranks[live].argmin(1)
            best = ranks[live, at]
            some = best < never
            live, at, best = live[some], at[some], best[some]
            if not len(live):
                break
            ids[live, at] = self.merged[best]
            # what stands behind the pair moves up by one
            source = np.minimum(column[None, 1:-1] + (column[None, 1:-1] > at[:, None]), width - 1) if width > 2 else None
            if source is not None:
                ids[live[:, None], column[None, 1:-1]] = ids[live[:, None], source]
                ranks[live[:, None], column[None, 1:-1]] = ranks[live[:, None], source]
            left[live] -= 1
            last = left[live] - 1
            ranks[live, np.minimum(last, width - 1)] = never
            here, nxt = at, np.minimum(at + 1, width - 1)
            ranks[live, here] = np.where(here < last, self._ranks(ids[live, here], ids[live, nxt]), never)
            before = np.maximum(at - 1, 0)
            ranks[live, before] = np.where(at > 0, self._ranks(ids[live, before], ids[live, at]), ranks[live, before])
            live = live[last > 0]
        return ids[column < left[:, None]].astype(np.uint32), left


def plain(words: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Which words Merges.encode() is right for, and of those the lower-cased letters and the marks behind, as bytes."""
    stem = pc.utf8_rtrim(words, characters=AFTER)
    size, whole = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (stem, words))
    easy = pc.utf8_is_alpha(stem).to_numpy(zero_copy_only=False) & (size <= LONGEST) & (whole - size <= MARKS)
    other = np.nonzero(easy & ~pc.string_is_ascii(stem).to_numpy(zero_copy_only=False))[0]
    if len(other):
        easy[other] = [unicodedata.is_normalized("NFC", w) and not any(c in w for c in ODD) for w in stem.take(pa.array(other)).to_pylist()]
    letters = pc.utf8_lower(stem.filter(pa.array(easy)))
    longer = pc.binary_length(letters).to_numpy(zero_copy_only=False) > LONGEST  # in lower case
    if longer.any():
        easy[np.nonzero(easy)[0][longer]] = False
        letters = letters.filter(pa.array(~longer))
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1][easy].astype(np.int64)
    raw, tail = np.frombuffer(words.buffers()[2] or b"", np.uint8), (whole - size)[easy]
    place = np.arange(MARKS)
    marks = np.where(place < tail[:, None], raw[np.minimum((ends - tail)[:, None] + place, max(len(raw) - 1, 0))] if len(raw) else 0, 0).astype(np.uint8)
    return easy, letters, np.ascontiguousarray(marks).view(f"S{MARKS}").ravel()
