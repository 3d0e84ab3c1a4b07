"""Token ids of whole texts by a public vocabulary, for packing and for the binary format.

The vocabulary's pre-tokenizer never joins characters across a space or a line
feed, so a text's ids are those of its space-free chunks in turn, and each distinct
chunk is encoded once and kept as little-endian 32-bit ids; a text is then a join of
byte strings. A chunk of Latin-1 letters with ASCII punctuation after them is two
pieces for the pre-tokenizer, so the library's model gets the lower-cased word alone
and equal words in other spellings are encoded once. Any other chunk goes through the
whole library. The caches are bounded in bytes; emptying one costs time only.
"""

from __future__ import annotations

import os
import re
import struct
from functools import cache

import numpy as np

END_ID = 1
CHUNK_BYTES, WORD_BYTES = 96 << 20, 40 << 20
#: Longer chunks are encoded each time, so that one chunk can't fill the cache.
LONG_CHUNK = 256
#: About what Python adds to a key and a value in a dict.
ENTRY_BYTES = 160
#: Letters whose lower case is one letter and the same for the library; then punctuation but the apostrophe, which may start a piece of its own.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")

MARKS = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def default_vocabulary() -> str:
    """Path of the default vocabulary on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, int]:
    """Code points that byte-level vocabularies write for bytes that aren't visible characters; the others stand for themselves."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + k for k, b in enumerate(x for x in range(256) if x not in visible)}


class Words:
    """Ids of lower-cased words and punctuation runs by the library's model; two generations, the older one is dropped when the younger is full."""

    def __init__(self, model) -> None:
        self.model, self.letters = model, byte_letters()
        self.young, self.old, self.used = {"": b""}, {}, 0

    def ids(self, piece: str) -> bytes:
        got = self.young.get(piece)
        if got is not None:
            return got
        got = self.old.get(piece)
        if got is None:
            word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(word)]
            got = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= LONG_CHUNK:
            self.used += len(piece) + len(got) + ENTRY_BYTES
            if self.used > WORD_BYTES:
                self.young, self.old, self.used = {"": b""}, self.young, 0
            self.young[piece] = got
        return got


class Chunks(dict):
    """Ids by chunk; a missing one is encoded, and kept unless its word is new: most new words don't come again."""

    def __init__(self, library) -> None:
        super().__init__({"": b""})
        self.library, self.words, self.used = library, Words(library.model), 0

    def __missing__(self, chunk: str) -> bytes:
        # most chunks are a word, or a word and one mark; the pattern takes the rest
        word, mark = (chunk, "") if chunk.isalpha() else (chunk[:-1], chunk[-1:])
        if not ((not mark or mark in MARKS and word.isalpha()) and (word.isascii() or max(word) <= "ÿ")):
            m = SIMPLE.fullmatch(chunk)
            word, mark = m.groups() if m else (None, "")
        if word is None:
            known, ids = True, self.library.encode(chunk, add_special_tokens=False).ids
            got = struct.pack(f"<{len(ids)}I", *ids)
        else:
            word = word.lower()
            known = word in self.words.young
            got = self.words.ids(word) + self.words.ids(mark)
        if known and len(chunk) <= LONG_CHUNK:
            self.used += len(chunk) + len(got) + ENTRY_BYTES
            self[chunk] = got
        return got


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, vocabulary: str | None = None, end_id: int | None = END_ID) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = Chunks(Tokenizer.from_file(vocabulary or default_vocabulary()))
        self.end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text, the end id included."""
        if self.known.used > CHUNK_BYTES:
            self.known.clear()
            self.known[""], self.known.used = b"", 0
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" "))) + self.end


@cache
def encoder(vocabulary: str | None, end_id: int | None) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(vocabulary, end_id)
