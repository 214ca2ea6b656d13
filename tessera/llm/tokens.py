"""Token ids of whole texts by a public word-level BPE file, with a cache of words.

The tokenizer file drops white space and never joins across it, so a text's ids are its words' ids one after another.
Words are told apart by 64-bit hashes; words not met before are encoded together, parted by a control character that
is one token of its own. Words that hold that character are encoded alone. The cache belongs to the worker process,
starts anew beyond a bound and never changes a result.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .textarrays import SOLID, Texts, ragged

SEPARATOR = "\x01"
CACHE_WORDS = 1_200_000
#: New words that are tokenised at a time: each is an object until its ids are stored.
LEARN = 1 << 14
#: How the word-level files split what their normaliser leaves, and the same for lower-case printable ASCII, where
#: bytes stand for themselves; ``STAND_IN`` is how such files write ``SEPARATOR``.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
STAND_IN = "\u0101"
PIECES = re.compile(rf"{STAND_IN}|'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^ {STAND_IN}a-z0-9]+")
#: Words of printable ASCII that hold no token which is looked for before normalising.
PRINTABLE = re.compile(r"(?:(?!<\|)[\x21-\x7e])+")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokenizer:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        (self.part,) = self.tokenizer.encode(SEPARATOR, add_special_tokens=False).ids
        self.light = self._light(path)
        self._clear()

    def _light(self, path: str):
        """The same model on words of printable ASCII that are split already, if the file splits as ``SPLIT`` does, else None."""
        from tokenizers import Tokenizer, pre_tokenizers

        file = json.loads(self.tokenizer.to_str())
        steps = [x.get("type") for x in (file["normalizer"] or {}).get("normalizers", [])]
        cut = (file["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        known = steps == ["NFC", "Replace", "Lowercase"] and file["normalizer"]["normalizers"][1].get("pattern") == {"Regex": r"\s+"}
        known = known and [x.get("type") for x in cut] == ["Split", "ByteLevel"] and cut[0].get("pattern") == {"Regex": SPLIT} and cut[0].get("invert") is True
        known = known and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex") and all(x["content"].startswith("<|") for x in file["added_tokens"])
        if not known or file["post_processor"]:
            return None
        light = Tokenizer.from_file(path)
        light.normalizer, light.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        return light if light.encode(STAND_IN, add_special_tokens=False).ids == [self.part] else None

    def _clear(self) -> None:
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.tiers = [(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)) for _ in range(2)]

    def _find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, size = np.full(len(h), -1), np.zeros(len(h), np.int64)
        for keys, starts, sizes in self.tiers:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                on = keys[at] == h
                start[on], size[on] = starts[at[on]], sizes[at[on]]
        return start, size

    def _learn(self, h: np.ndarray, words: list[str]) -> None:
        kinds = [2 if SEPARATOR in w else 1 if self.light is None or not PRINTABLE.fullmatch(w) else 0 for w in words]
        light, plain, alone = ([k for k, x in enumerate(kinds) if x == kind] for kind in range(3))
        lists, sizes = [], []
        for some, tokenizer in ((light, self.light), (plain, self.tokenizer)):
            for a in range(0, len(some), 512):
                text = f" {SEPARATOR} ".join(words[k] for k in some[a : a + 512])
                if some is light:
                    text = " ".join(PIECES.findall(text.lower().replace(SEPARATOR, STAND_IN)))
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.part)
                sizes.append(np.diff(cuts, prepend=-1, append=len(ids)) - 1)
                lists.append(np.delete(ids, cuts))
        for k in alone:
            lists.append(np.array(self.tokenizer.encode(words[k], add_special_tokens=False).ids, np.uint32))
            sizes.append(np.array([len(lists[-1])]))
        size, start, total = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), sum(len(x) for x in lists)
        if self.used + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), total), np.uint32)])
        self.ids[self.used : self.used + total] = np.concatenate(lists)
        size[light + plain + alone] = sizes = np.concatenate(sizes)
        start[light + plain + alone] = self.used + np.cumsum(sizes) - sizes
        self.used += total
        recent = tuple(np.concatenate([x, y]) for x, y in zip(self.tiers[1], (h, start.astype(np.int32), size.astype(np.int32)), strict=True))
        if len(recent[0]) * 4 > len(self.tiers[0][0]):
            recent = tuple(np.concatenate([x, y]) for x, y in zip(self.tiers[0], recent, strict=True))
            self.tiers[0], recent = self._sorted(recent), tuple(x[:0] for x in recent)
        self.tiers[1] = self._sorted(recent)

    @staticmethod
    def _sorted(t):
        order = np.argsort(t[0])
        return tuple(x[order] for x in t)

    def encode(self, texts: Texts, words: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and the number of ids of each text; ``words`` are those of the texts, where they are known."""
        s, e, owner = words or texts.words(SOLID)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        if len(self.tiers[0][0]) > CACHE_WORDS:
            self._clear()
        h, first, back = np.unique(texts.hashes(s, e), return_index=True, return_inverse=True)
        start, size = self._find(h)
        new = np.flatnonzero(start < 0)
        if len(new):
            raw = texts.buf.tobytes()
            a, b = s[first[new]].tolist(), e[first[new]].tolist()
            for k in range(0, len(new), LEARN):
                self._learn(h[new[k : k + LEARN]], [raw[x:y].decode() for x, y in zip(a[k : k + LEARN], b[k : k + LEARN], strict=True)])
            del raw, a, b
            start, size = self._find(h)
        n = size[back]
        ids = self.ids[ragged(start[back], n)]
        return ids, np.bincount(owner, weights=n, minlength=len(texts))[: len(texts)].astype(np.int64)


_made: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """The worker process's tokenizer for a file."""
    if path not in _made:
        _made[path] = WordTokenizer(path)
    return _made[path]
