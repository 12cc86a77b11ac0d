"""Token ids of whole texts by a public tokenizer file, a word at a time."""

from __future__ import annotations

import functools
import os
import re

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

END_ID = 1
#: Words remembered by a Python worker; a full memory starts anew.
REMEMBERED = 400_000
LONG_WORD = 64

# Letters of Latin-1, which NFC leaves alone, and ASCII punctuation without the apostrophe.
_PLAIN = re.compile(r"""([A-Za-zÀ-ÖØ-öø-ÿ]*)([!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)""")


def word_bpe_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """Character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 upward."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class WordEncoder(dict):
    """Ids (little-endian uint32 bytes) by word, for a BPE file that splits at and drops white space.

    A text's ids are those of its white-space words in a row, so each word is encoded once and remembered.
    A word of plain letters followed by punctuation is two pieces for the model; any other word goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()

    def piece(self, piece: str) -> bytes:
        if piece.isascii():
            spelled = piece
        else:
            spelled = "".join([self.letters[b] for b in piece.encode()])
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelled)])

    def __missing__(self, word: str) -> bytes:
        plain = _PLAIN.fullmatch(word)
        if not word:
            ids = b""
        elif plain:
            letters, marks = plain.groups()
            if letters and marks:
                ids = self[letters] + self[marks]
            else:
                ids = self.piece(letters.lower() or marks)
        else:
            found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = b"".join([i.to_bytes(4, "little") for i in found])
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of the text; NULL is the empty text."""
        if not text:
            return b""
        words = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        return b"".join(map(self.__getitem__, words))


@functools.lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """Encoder of this Python process."""
    return WordEncoder(path)
