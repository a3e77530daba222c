"""Token ids of whole texts by a public tokenizer file, with each distinct word encoded once.

For the lower-casing word tokenizer (`FAST`: its normaliser and word pattern), words are cut from the raw
bytes by array operations and only words not seen before go through the vocabulary's merges; the
ids of a text are then gathered. Texts with other characters take the tokenizer itself.
"""

from __future__ import annotations

import json
import re
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from .common import utf8
from .ngrams import LOWER, span_hash

#: The word pattern and normalisers for which words can be encoded one by one (fixed values).
FAST = {"normalizers": ["NFC", "Replace", "Lowercase"],
        "pattern": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "suffix": "</w>"}
#: Characters of texts whose words the pattern below cuts as FAST does (Latin letters and common signs).
PLAIN = re.compile("[\t\n\r -~¡-§©«¬®°±¿-įĲ-ňŊ-ž"
                   "–—‘’“”•…€]*")
WORD = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ž]+|[0-9]|[^\\s0-9a-zß-öø-ž]+")

BLANK, LETTER, DIGIT, SIGN, OTHER = range(5)
KIND = np.full(256, OTHER, np.uint8)
KIND[0x21:0x7F] = SIGN
KIND[[0x20, 0x09, 0x0A, 0x0D]] = BLANK
KIND[ord("a"):ord("z") + 1] = LETTER
KIND[ord("0"):ord("9") + 1] = DIGIT
KIND[0x80:0xC0] = LETTER
KIND[0xC3] = LETTER
KIND[0x41:0x5B] = LETTER  # before lowering
APOSTROPHE = np.zeros(256, bool)
APOSTROPHE[[ord(c) for c in "stmdrvl"]] = True

#: byte -> character under which byte-level vocabularies list it: itself where printable, else from 256 on
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHAR = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTED))}

#: words kept per worker process; when there are more, it starts anew
CACHE_WORDS = 120_000


class Encoder:
    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.merge = self.tok.model.tokenize
        self.cache: dict[int | str, bytes] = {}
        j = json.loads(self.tok.to_str())
        try:
            self.fast = ([n["type"] for n in j["normalizer"]["normalizers"]] == FAST["normalizers"]
                         and j["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == FAST["pattern"]
                         and j["model"]["end_of_word_suffix"] == FAST["suffix"])
        except (KeyError, TypeError, IndexError):
            self.fast = False

    def _word(self, word: bytes) -> bytes:
        s = word.decode("latin-1")
        if not word.isascii():
            s = s.translate(BYTE_CHAR)
        return array("I", [t.id for t in self.merge(s)]).tobytes()

    def _text(self, text: str) -> np.ndarray:
        if self.fast and "<|" not in text and PLAIN.fullmatch(text):
            words, cache = WORD.findall(text.lower()), self.cache
            for w in set(words).difference(cache.keys()):
                cache[w] = self._word(w.encode())
            return np.frombuffer(b"".join(map(cache.__getitem__, words)), np.uint32)
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, col: pa.Array) -> list[np.ndarray]:
        """Ids of each text (null: none)."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        if not self.fast:
            return [self._text(t or "") for t in col.to_pylist()]
        raw, offs = utf8(col)
        n = len(raw)
        if n == 0:
            return [np.zeros(0, np.uint32)] * len(col)
        low = LOWER[raw]
        after_c3 = np.zeros(n, bool)
        after_c3[1:] = raw[:-1] == 0xC3
        low[after_c3 & (raw >= 0x80) & (raw <= 0x9E)] += 0x20
        kind = KIND[raw]
        odd = (kind == OTHER) | (after_c3 & ((raw == 0x97) | (raw == 0xB7))) \
            | ((raw >= 0x80) & (raw < 0xC0) & ~after_c3)
        odd[:-1] |= (raw[:-1] == ord("'")) & APOSTROPHE[low[1:]]
        odd[:-1] |= (raw[:-1] == ord("<")) & (raw[1:] == ord("|"))
        slow = np.add.reduceat(odd, np.minimum(offs[:-1], n - 1)) > 0
        slow &= offs[1:] > offs[:-1]
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        edge[0] = True
        edge[1:n] |= (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        word = kind != BLANK
        starts = np.flatnonzero(word & edge[:n])
        ends = np.flatnonzero(word & edge[1:]) + 1
        doc = np.searchsorted(offs, starts, side="right") - 1
        h = span_hash(low, starts, ends)
        if slow.any():
            use = ~slow[doc]
            starts, ends, doc, h = starts[use], ends[use], doc[use], h[use]
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        cache, found, text = self.cache, [], low.tobytes()
        for key, a, b in zip(uniq.tolist(), starts[first].tolist(), ends[first].tolist()):
            ids = cache.get(key)
            if ids is None:
                ids = cache[key] = self._word(text[a:b])
            found.append(ids)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        table = np.frombuffer(b"".join(found), np.uint32)
        begin = np.cumsum(sizes) - sizes
        count = sizes[inv]
        done = np.cumsum(count)
        flat = table[np.repeat(begin[inv] - (done - count), count) + np.arange(done[-1] if len(done) else 0)]
        ends_of = np.concatenate([[0], done])[np.searchsorted(doc, np.arange(len(col)), side="right")]
        out = np.split(flat, ends_of[:-1])
        for i in np.flatnonzero(slow):
            out[i] = self._text(raw[offs[i]:offs[i + 1]].tobytes().decode("utf-8"))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
