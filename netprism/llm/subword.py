"""Sub-word ids of whole texts with the ``tokenizers`` library, word by word.

The two BPE vocabularies cut a text into pieces before any merge is applied.
A text is cut here at places where the library's own pre-tokenizer always
cuts, and the ids of each distinct piece are kept in a dictionary that the
worker process holds.  A text for which those places are not certain (special
tokens, runs of blanks, rare white space) goes to the library as a whole.
``tests/llm`` compares both ways with the library on the whole text.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

from .common import process_cache

#: Most pieces a worker keeps (about 200 bytes each); beyond it the dictionary is emptied and refilled.
CACHE_PIECES = 600_000
#: Bytes of the longest piece kept; longer ones hardly come twice.
LONGEST = 24
#: Marks that a word often ends with.
STOPS = frozenset((b".", b",", b";", b":", b"!", b"?"))


def byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: printable
    Latin-1 bytes stand for themselves, the others get code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class _Pieces(dict):
    """piece (bytes) -> its ids as little-endian bytes."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, piece):
        ids = self.make(piece)
        if len(piece) <= LONGEST:
            if len(self) >= self.most:
                self.clear()
            self[piece] = ids
        return ids


class SubwordEncoder:
    """Base: ``ids(text)`` gives the ids of a UTF-8 text as a numpy array."""

    # letters that every version of Unicode calls letters: A-Z, a-z, U+00C0-U+00FF but x and division
    WORD = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"

    def __init__(self, path: str, most: int = CACHE_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65_536 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"  # native order, little-endian on all that Spark runs on
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.pieces = _Pieces(self.piece, most)

    def pack(self, ids) -> bytes:
        return array(self.code, ids).tobytes()

    def whole(self, text: bytes) -> bytes:
        return self.pack(self.tokenizer.encode(text.decode("utf-8"), add_special_tokens=False).ids)

    def merged(self, piece: bytes) -> bytes:
        """Ids of a piece that is one word of the pre-tokenizer."""
        written = piece.decode("latin-1")
        if piece.isascii():  # printable ASCII stands for itself
            written = written.replace(" ", self.letters[32])
        else:
            written = written.translate(self.letters)
        return self.pack([t.id for t in self.model.tokenize(written)])

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.encoded(text), self.dtype)


class WordEncoder(SubwordEncoder):
    """word_bpe_49k: lower case, white space dropped, words never span white space."""

    one_word = re.compile(SubwordEncoder.WORD + rb"\Z")
    word_stop = re.compile(rb"(" + SubwordEncoder.WORD + rb")([.,;:!?]+)\Z")
    # how the pre-tokenizer cuts lower-case ASCII without apostrophes and blanks
    ascii_parts = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")

    def piece(self, piece: bytes) -> bytes:
        if piece.isalpha():  # of bytes: ASCII letters only
            return self.merged(piece)
        if self.one_word.match(piece):
            return self.merged(piece.decode("utf-8").lower().encode("utf-8"))
        if piece[-1:] in STOPS and (m := self.word_stop.match(piece)):
            return self.pieces[m[1]] + self.pieces[m[2]]
        if piece.isascii() and b"'" not in piece and len(parts := self.ascii_parts.findall(piece)) > 1:
            return b"".join([self.pieces[x] for x in parts])
        return self.whole(piece)

    def encoded(self, text: bytes) -> bytes:
        if b"<|" in text:  # perhaps a special token, which is case sensitive
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.lower().split()))


class ByteEncoder(SubwordEncoder):
    """byte_bpe_50k: a blank belongs to the word after it, a line feed stands alone."""

    one_word = re.compile(rb" ?" + SubwordEncoder.WORD + rb"\Z")
    word_stop = re.compile(rb"( ?" + SubwordEncoder.WORD + rb")([.,;:!?]+)\Z")
    # white space that may run together or is rare, and the mark used for cutting
    unsure = re.compile(rb"[ \n][ \n]|[\x00\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e"
                        rb"|\xe2\x80[\x80-\x8b\xa8\xa9\xaf]|\xe2\x81[\x9f\xa0]|\xe3\x80\x80|\xef\xbb\xbf|<\|")
    ascii_parts = re.compile(rb" ?[A-Za-z]+| ?[0-9]+| ?[^ \nA-Za-z0-9]+")

    def piece(self, piece: bytes) -> bytes:
        if piece[1:].isalpha() and piece[0] < 128 and (piece[0] == 32 or piece[:1].isalpha()) or self.one_word.match(piece):
            return self.merged(piece)
        if piece[-1:] in STOPS and (m := self.word_stop.match(piece)):
            return self.pieces[m[1]] + self.pieces[m[2]]
        if piece.isascii() and b"'" not in piece and len(parts := self.ascii_parts.findall(piece)) > 1:
            return b"".join([self.pieces[x] for x in parts])
        return self.whole(piece)

    def encoded(self, text: bytes) -> bytes:
        if self.unsure.search(text):
            return self.whole(text)
        cut = text.replace(b" ", b"\x00 ").replace(b"\n", b"\x00\n\x00").split(b"\x00")
        return b"".join(map(self.pieces.__getitem__, cut))


def encoder(kind: str, path: str, most: int = CACHE_PIECES) -> SubwordEncoder:
    """The worker's encoder for a vocabulary file (loaded once per process), with room for ``most`` pieces."""
    held = process_cache("encoders")
    if (kind, path, most) not in held:
        held[kind, path, most] = {"word": WordEncoder, "byte": ByteEncoder}[kind](path, most)
    return held[kind, path, most]
