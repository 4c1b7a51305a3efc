"""Ids of a `tokenizers` file whose splitter never joins text across white space, with a cache of words.

Normalisation and merges of such a tokenizer stay within white space, so a word's ids don't depend on its neighbours and
can be kept. The cache is bounded: when full, it starts anew. Texts that hold an added token of the file are encoded
whole, as the file says: such a token is found in the raw text, before anything is split or normalised.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Words kept in a worker, at about 200 bytes each.
CACHE = 1_000_000
#: str.split() parts at these, the tokenizer does not; texts that hold any are encoded whole.
_OTHER = re.compile("[\x1c-\x1f]")
#: ASCII punctuation without the apostrophe, which may belong to the letters behind it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _lower(text: str) -> str:
    """Lower case where it's surely what the tokenizer makes of each character: in Latin-1."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


class WordTokens:
    def __init__(self, path: str, kept: int = CACHE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.kept = kept
        self.cache: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # of the tokens that end a run of letters
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [None if _OTHER.search(x) or any(t in x for t in self.added) else _lower(x).split() for x in texts]
        if len(self.cache) > self.kept:
            self.cache.clear()
        cache = self.cache
        new = set().union(*(x for x in split if x)).difference(cache)
        # A word with a run of marks behind its last letter is the word's ids, then the run's.
        parts = [(w, c, w[len(c) :]) for w in new if (c := w.rstrip(_MARKS)) != w and c and c[-1] < "\u0100" and c[-1].isalpha()]
        new.difference_update([w for w, _, _ in parts])
        for _, c, run in parts:
            if c not in cache:
                new.add(c)
            if run not in cache:
                new.add(run)
        # Words of Latin-1 letters are one run each, so many are encoded as one text and parted at the ends of runs.
        plain = [w for w in new if w.isalpha() and max(w) < "\u0100"]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            ends, held = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist(), ids.tobytes()
            cache.update(zip(part, [held[i:j] for i, j in zip([0, *ends], ends, strict=False)], strict=True))
        rest = list(new.difference(plain))
        for at in range(0, len(rest), 10_000):
            part = rest[at : at + 10_000]
            cache.update(zip(part, [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)], strict=True))
        for w, c, run in parts:
            cache[w] = cache[c] + cache[run]
        out = []
        for text, words in zip(texts, split, strict=True):
            ids = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes() if words is None else b"".join(map(cache.__getitem__, words))
            out.append(np.frombuffer(ids, dtype="<u4"))
        return out


@functools.lru_cache(maxsize=1)
def word_tokens(path: str, kept: int = CACHE) -> WordTokens:
    return WordTokens(path, kept)
