"""Token ids of a word BPE vocabulary that drops white space, one word at a time.

The library's pipeline for such a file is: special strings, NFC, white space runs to one blank, lower case, a split into
pieces, merges inside each piece. None of these looks across an ASCII blank, and no special string has one inside, so the
ids of a text are the ids of its words (runs between ASCII white space) in a row. A table of words answers almost all of
them; what it lacks the library encodes, many words in one call with a special string between them, whose id then shows
where each word's ids end.

Words are looked up in lower case if that can't change a result: if the text has neither a character from U+0180 on, so that
NFC has nothing to compose, nor the beginning of a special string.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

TOKENIZER = "word_bpe_49k.json"
#: Words that a worker's table holds, and those of one slice of texts; beyond it all but the first half is forgotten: what
#: came first is what is frequent.
TABLE_MAX = 1 << 20
TOGETHER = 512
#: Texts whose words are told apart at once.
TOGETHER_BYTES = 8 << 20
STOPS = b".,;:!?"
HIGH = re.compile(rb"[\xc6-\xff]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``value`` makes of a word's ids what the table keeps; the value of two words' ids in a row must be the values' sum."""

    def __init__(self, path: str, value: Callable[[np.ndarray], object] = np.ndarray.tobytes) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        if any(c.isspace() for s in special for c in s):
            raise ValueError("a special string with white space inside")
        self.between, self.between_id = next(iter(special.items()), (None, -1))
        self.prefixes = {s[:2].encode().lower() for s in special}
        suffix = getattr(self.library.model, "end_of_word_suffix", None)
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.value = value
        self.table: dict[bytes, object] = {}

    def may_be_special(self, text: bytes) -> bool:
        low = text.lower()
        return any(p in low for p in self.prefixes)

    def folded(self, text: bytes) -> bytes:
        """The text as its words are looked up: in lower case where that is safe."""
        low = text.lower()
        if any(p in low for p in self.prefixes) or (not text.isascii() and HIGH.search(text)):
            return text
        return low

    def words(self, text: bytes) -> list[bytes]:
        return self.folded(text).split()

    def encoded(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word. Words of letters only are one piece each, and its last id, no other, ends a word."""
        out: dict[bytes, np.ndarray] = {}
        letters, plain = [], []
        for w in words:
            if self.ends is not None and not HIGH.search(w) and w.decode().lower().isalpha():
                letters.append(w)
            elif self.between and not self.may_be_special(w):
                plain.append(w)
        for some, glue in [(x[i : i + TOGETHER], g) for x, g in ((letters, " "), (plain, self.between)) for i in range(0, len(x), TOGETHER)]:
            flat = np.array(self.library.encode(glue.join(w.decode() for w in some), add_special_tokens=False).ids, np.int64)
            if glue == " ":
                after = np.flatnonzero(self.ends[flat]) + 1
                parts = zip(some, [0, *after[:-1].tolist()], after.tolist(), strict=True)
            else:
                at = np.flatnonzero(np.append(flat, self.between_id) == self.between_id)
                parts = zip(some, [0, *(at[:-1] + 1).tolist()], at.tolist(), strict=True)
            flat = flat.astype(self.kind)
            for w, begin, end in parts:
                out[w] = flat[begin:end]
        for w in words:
            if w not in out:
                out[w] = np.array(self.library.encode(w.decode(), add_special_tokens=False).ids, self.kind)
        return [out[w] for w in words]

    def learn(self, new: set[bytes], needed: list[bytes]) -> None:
        """Puts words into the table. A full one first forgets all but its first half and what is needed now."""
        if len(self.table) + 2 * len(new) > TABLE_MAX:
            old = self.table
            self.table = dict(list(old.items())[: TABLE_MAX // 2])
            self.table.update((w, old[w]) for w in needed if w in old)
        table = self.table
        # stops after a letter or figure are a piece of their own: such a word is the sum of its two parts
        split = {w: core for w in new if (core := w.rstrip(STOPS)) and len(core) < len(w) and core[-1:].isalnum()}
        order = list((new.difference(split) | {p for w, core in split.items() for p in (core, w[len(core) :])}).difference(table))
        table.update(zip(order, map(self.value, self.encoded(order))))
        table.update((w, table[c] + table[w[len(c) :]]) for w, c in split.items())

    def coded(self, texts: list[bytes]) -> tuple[list, np.ndarray, np.ndarray]:
        """The values of the different words; for all words in order, the place of each one's value; the texts' first places.
        A word is looked up once for each slice of texts, not once for each time it stands there."""
        words = pc.ascii_split_whitespace(pa.array(map(self.folded, texts), pa.large_string()))
        known = words.flatten().dictionary_encode()
        different = known.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        values = list(map(self.table.get, different))
        if None in values:
            self.learn({w for w, v in zip(different, values) if v is None}, different)
            values = list(map(self.table.__getitem__, different))
        return values, known.indices.to_numpy(), words.offsets.to_numpy()

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        """For encoders that keep the bytes of the ids."""
        out: list[np.ndarray] = []
        for a, b in slices(texts, TOGETHER_BYTES):
            values, places, firsts = self.coded(texts[a:b])
            sizes = np.fromiter(map(len, values), np.int64, len(values)) // self.kind.itemsize
            flat, begins, n = np.frombuffer(b"".join(values), self.kind), np.cumsum(sizes) - sizes, sizes[places]
            ends = np.r_[0, np.cumsum(n)]
            ids = flat[np.repeat(begins[places] - ends[:-1], n) + np.arange(ends[-1])]
            out += np.split(ids, ends[firsts[1:-1]]) if b > a else []
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
