"""Token ids of whole texts for word-level BPE vocabularies, at the speed of a word cache.

The library cuts a text into words, numbers and runs of symbols before it merges, so a text's ids are its cuts'
ids in a row. Each worker keeps the ids of cuts it has met; new ones go to the library in one batch. Texts of
Latin letters, digits and ASCII symbols are lower-cased and cut here by the vocabulary's own pattern; a word
with anything else goes to the library as it is, and a text in which Python and the library may see white space
differently goes there whole."""

from __future__ import annotations

import re

import numpy as np

from .common import one_per_worker, tokenizer_path

#: Anything for which lower-casing and the cut below might differ from the library's: what is not Latin-1, numbers beyond 0-9.
_OTHER = re.compile(r"[^\t-\r\x20-\x7eß-öø-ÿÀ-ÖØ-Þ]|<\|")
#: As above, or a point or comma inside a run of symbols, where a space before it would cut the run.
_MIXED = re.compile(r"[^\t-\r\x20-\x7eß-öø-ÿÀ-ÖØ-Þ]|<\||[!-/:-@\[-`{-~][.,]")
_CUT = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\t-\ra-z0-9ß-öø-ÿ ]+")
#: Characters on which Python's and the library's ideas of white space may differ.
_ODD = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")
#: Marks a key of the cache that is a word for the library as it is.
_AS_IS = "\0"


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet of GPT-2: printable bytes stand for themselves, the rest follow from code point 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts to little-endian unsigned ids. `limit` bounds the cuts kept, at about 200 bytes each, and
    `chars` the characters and ids in them; what is beyond is dropped before the next texts."""

    def __init__(self, path: str, limit: int = 1_000_000, chars: int = 32_000_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.pieces = Tokenizer.from_file(path)
        self.pieces.normalizer = None
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces.encode_special_tokens = True
        vocab = self.whole.get_vocab()
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items() if chr(b) != " "})
        self.known: dict[str, bytes] = {}
        self.limit, self.chars, self.held = limit, chars, 0

    def _parts(self, text: str) -> list[str] | None:
        """Keys of the cache whose ids in a row are the text's: lower-cased words, or words for the library as they are."""
        if not _MIXED.search(text):
            return text.lower().replace(".", " .").replace(",", " ,").split()
        if _ODD.search(text):
            return None
        if not _OTHER.search(text):
            return text.lower().split()
        return [_AS_IS + w if _OTHER.search(w) else w.lower() for w in text.split()]

    def _ids(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, new: set[str]) -> None:
        words = [(w, _CUT.findall(w)) for w in new if w[0] != _AS_IS]
        for w in new.difference([w for w, _ in words]):
            self.known[w] = self._ids(w[1:])
        cuts = list({c for _, found in words for c in found}.difference(self.known))
        if cuts:
            text = " ".join(cuts)
            if not text.isascii():
                text = text.encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.pieces.encode_batch_fast([text], add_special_tokens=False)[0].ids)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(cuts):
                raise ValueError("this vocabulary does not mark word ends")
            data, size = ids.astype(self.dtype).tobytes(), self.dtype.itemsize
            ends = (ends * size).tolist()
            self.known.update(zip(cuts, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        get = self.known.__getitem__
        self.known.update([(w, b"".join(map(get, found))) for w, found in words if len(found) != 1])
        self.held += sum(map(len, new)) + sum(map(len, cuts))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without added ids, as bytes of self.dtype."""
        if len(self.known) > self.limit or self.held > self.chars:
            self.known.clear()
            self.held = 0
        parts = [self._parts(t) for t in texts]
        new = set().union(*filter(None, parts)).difference(self.known)
        if new:
            self._learn(new)
        get = self.known.__getitem__
        return [self._ids(t) if p is None else b"".join(map(get, p)) for t, p in zip(texts, parts)]


def word_encoder(name: str, limit: int = 1_000_000) -> WordEncoder:
    """This worker's encoder for a vocabulary, keeping up to `limit` cuts."""
    return one_per_worker(("words", name, limit), lambda: WordEncoder(tokenizer_path(name), limit))
