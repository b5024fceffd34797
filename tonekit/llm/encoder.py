"""Token ids of whole texts with a public tokenizer, one tokenizer call per distinct unit.

A text is cut into units at places where the tokenizer's own pre-tokenizer always cuts: at white
space. The ids of a text are the ids of its units in order, so each distinct unit is tokenized
once per worker and then looked up. Texts with control characters that regex engines disagree on
(white space to one, not to another), or with the content of an added token, at which the
tokenizer cuts before anything else, go to the tokenizer whole.

``encode_array`` takes an Arrow array: Arrow cuts its texts and numbers the distinct units, so Python sees each of them
once an array, and Arrow puts the ids together. If a space opens a unit, it cuts texts in Python, as ``encode`` does.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: Units kept per worker (the first ones met, so the frequent ones); longer units are not kept.
CACHE_UNITS, CACHE_CHARS = 500_000, 40
_DISPUTED = "[\x1c-\x1f\x85᠎]"
_WITH_SPACE = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Marks that pre-tokenizers part from the word before them (an apostrophe may bind). Not from words with a capital
#: dotted I, whose lower case ends in a combining mark that goes with the marks.
_MARKS = "!#$%&()*+,./:;=?@|-"
#: Words that the vocabulary's model can be given directly: no rule of a tokenizer parts or changes
#: them but lower-casing, which is the same by any rule for these letters.
_LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PROBES = [" the", " Été", " über", " straße", " ÑANDÚ", " ontiatthing", "Œuvre"[1:], " ÿ", " Ààòõ"]
#: Byte-level alphabet: printable bytes are themselves, the others follow from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_MOVED = [b for b in range(256) if b not in _PRINTED]
_ALPHABET = "".join(chr(0x100 + _MOVED.index(b) if b in _MOVED else b) for b in range(256))


class UnitEncoder:
    """``drops_space``: the tokenizer ignores white space; otherwise a space opens the next unit."""

    def __init__(self, path: str, drops_space: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.split = str.split if drops_space else _WITH_SPACE.findall
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.whole = re.compile("|".join([_DISPUTED, *map(re.escape, sorted(added, key=len, reverse=True))]), re.IGNORECASE).search
        # what a text has that the search above could find, whatever the case of letters
        starts = [re.escape(re.match(r"[!-/:-@\[-`{-~]*", t)[0]) for t in added]
        self.suspect = "|".join([_DISPUTED, *starts])
        self.cache: dict[str, bytes] = {}
        self.model, self.lowers = self.tokenizer.model, drops_space
        probes = [p.strip() for p in _PROBES] if drops_space else _PROBES
        self.direct = [self._word(p) for p in probes] == self._ids(probes)

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _word(self, unit: str) -> bytes:
        """Ids of a unit that is one word, from the byte-level model."""
        text = unit.lower() if self.lowers else unit
        if self.lowers and text.isascii():
            return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        text = text.encode().decode("latin-1").translate(_ALPHABET)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers (null: none)."""
        get, out, later, missing = self.cache.get, [b""] * len(texts), [], {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.whole(text):
                out[i] = self._ids([text])[0]
                continue
            units = self.split(text)
            parts = list(map(get, units))
            if None in parts:
                at, gaps = -1, []
                for _ in range(parts.count(None)):
                    at = parts.index(None, at + 1)
                    gaps.append(at)
                    missing[units[at]] = None
                later.append((i, units, parts, gaps))
            else:
                out[i] = b"".join(parts)
        if missing:
            missing = dict(zip(missing, self._learn(list(missing))))
            for i, units, parts, gaps in later:
                for at in gaps:
                    parts[at] = missing[units[at]]
                out[i] = b"".join(parts)
        return out

    def encode_array(self, texts: pa.Array, tail: bytes = b"") -> pa.Array:
        """Ids of each text and ``tail``, as binaries like those of ``encode``."""
        if not self.lowers:
            return pa.array([b + tail for b in self.encode(texts.to_pylist())], pa.binary())
        texts = pc.fill_null(texts, "")
        suspects = np.flatnonzero(pc.match_substring_regex(texts, self.suspect).to_numpy(zero_copy_only=False))
        whole = {int(i): t for i in suspects if self.whole(t := texts[int(i)].as_py())}
        if whole:
            texts = pc.if_else(pa.array([i in whole for i in range(len(texts))]), "", texts)
        words = pc.ascii_split_whitespace(texts)
        numbered = words.flatten().dictionary_encode()
        ids = self._known(numbered.dictionary)
        # the units of each text and one more place, for its tail or for a whole text's ids and tail
        ends = words.offsets.to_numpy()
        last = ends[1:] - ends[0] + np.arange(len(texts))
        unit = np.full(len(numbered) + len(texts), len(ids), dtype=np.int32)
        inner = np.ones(len(unit), dtype=bool)
        inner[last] = False
        unit[inner] = numbered.indices.to_numpy()
        unit[last[list(whole)]] = len(ids) + 1 + np.arange(len(whole))
        table = pa.array([*ids, tail, *(b + tail for b in self._ids(list(whole.values())))], pa.binary())
        found = table.take(pa.array(unit))
        _, places, content = found.buffers()
        places = np.frombuffer(places, dtype=np.int32)[: len(unit) + 1]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(places[np.append(0, last + 1)]), content])

    def _known(self, distinct: pa.Array) -> list[bytes]:
        """Ids of distinct units without ASCII white space."""
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(distinct)], pa.int32()), distinct), " ")
        units = joined[0].as_py().split(" ")
        ids = list(map(self.cache.get, units))
        if None in ids:
            gaps = [i for i, b in enumerate(ids) if b is None]
            for i, b in zip(gaps, self._learn([units[i] for i in gaps])):
                ids[i] = b
        return ids

    def _learn(self, units: list[str]) -> list[bytes]:
        """Ids of new units, all different; a word with marks behind it is made of its two parts."""
        get, out, rest, new = self.cache.get, [b""] * len(units), [], {}
        letters, word_ids, direct = _LETTERS.fullmatch, self._word, self.direct
        for i, u in enumerate(units):
            word, marks = u.rstrip(_MARKS), b""
            if len(word) < len(u):
                if not (word[1:] if word[:1] == " " else word).isalpha() or "İ" in word:
                    rest.append(i)
                    continue
                behind = u[len(word):]
                marks = get(behind) or new.get(behind)
                if marks is None:
                    marks = new[behind] = self._ids([behind])[0]
            ids = get(word) or new.get(word)
            if ids is None:
                if not direct or not letters(word):
                    rest.append(i)
                    continue
                ids = new[word] = word_ids(word)
            out[i] = new[u] = ids + marks if marks else ids
        for i, ids in zip(rest, self._ids([units[i] for i in rest])):
            out[i] = new[units[i]] = ids
        if len(self.cache) < CACHE_UNITS:
            self.cache.update(islice(((u, b) for u, b in new.items() if len(u) <= CACHE_CHARS), CACHE_UNITS - len(self.cache)))
        return out


@lru_cache(maxsize=4)
def encoder(path: str, drops_space: bool) -> UnitEncoder:
    """The worker's encoder of a vocabulary file; kept from task to task."""
    return UnitEncoder(path, drops_space)
