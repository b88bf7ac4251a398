"""Token ids of whole texts by the tokenizers library, with a cache of the pieces between spaces.

The vocabularies split a text at white space before any merge, so a text's ids are its pieces' ids in a row. A piece is what
lies between two line feeds or spaces, with what is before it, in lower case where the vocabulary has no other. ASCII marks at a
piece's end, after a letter, are a piece of their own. Letters go to the library's merges as they are; any other piece goes
through the whole tokenizer. Arrow splits many texts at once, so that each different piece of some MB is looked up once.
Texts in which white space follows white space, other white space, a zero character or a special token's mark occurs, or that
start or end in white space, are encoded as a whole. So the ids are the library's for every text, which the tests hold
against it.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space that does not separate pieces here, and the mark of special tokens.
ODD = re.compile("[\0\t\x0b\x0c\r\x1c-\x1f\x85\xa0  -     　]|<\\|")
#: Letters whose lower case may be more than one.
WIDE = re.compile("[^\0-\xff]")
#: For Arrow: texts that are encoded as a whole.
WHOLE = rf"\A[ \n]|[ \n]\z|[ \n][ \n]|{ODD.pattern}"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
MAX_PIECES = 500_000
#: Bytes of texts that are split at once.
TEXT_BYTES = 1 << 22


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces(dict):
    """Ids of pieces as bytes, learned when first asked for; of MAX_PIECES, the half that was not asked for since is forgotten."""

    def __init__(self, path: str, dtype: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.merges = self.library.model
        self.dtype = np.dtype(dtype).newbyteorder("<")
        self.code = {2: "H", 4: "I"}[self.dtype.itemsize]
        self.letters = byte_letters()
        self.space = self.letters[32]
        self.lower = "Lowercase" in str(self.library.normalizer)  # such vocabularies also drop white space and compose letters
        self.feed = self.plain("\n")
        self.old: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def merged(self, pretoken: str) -> list[int]:
        if pretoken[0] == " " and pretoken.isascii():  # printable letters after it stand for themselves
            letters = self.space + pretoken[1:]
        else:
            letters = pretoken.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.merges.tokenize(letters)]

    def __missing__(self, piece: str) -> bytes:
        """A piece is a word with a space before it, a line feed with a word after it, or a zero with a word that has no space before it."""
        if len(self) >= MAX_PIECES // 2:
            self.old = dict(self)
            self.clear()
        found = self.old.get(piece)
        if found is None:
            if piece[:1] == "\n":
                found = self.feed + self.word(piece[1:], "")
            elif piece[:1] in ("", "\0"):
                found = self.word(piece[1:], "")
            else:
                found = self.word(piece, " ")
        self[piece] = found
        return found

    def piece(self, piece: str) -> bytes:
        stem = piece.rstrip(MARKS)
        if len(stem) == len(piece):
            return self[piece]
        last = stem[-1:]
        if last in ("\n", "\0") or last.isalpha() and not (self.lower and last > "\xff"):
            return self[stem] + self["\0" + piece[len(stem) :]]
        return self[piece]

    def word(self, word: str, space: str) -> bytes:
        """The ids of a text without white space, after the given space."""
        if not word:
            return b""
        if word.isalpha() and not (self.lower and max(word) > "\xff"):
            ids = self.merged(word.lower() if self.lower else space + word)
            return struct.pack(f"<{len(ids)}{self.code}", *ids)
        return self.plain(space + word)

    def encode(self, text: str) -> bytes:
        if not text or text[-1].isspace() or text[0].isspace() or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or ODD.search(text):
            return self.plain(text)
        if self.lower:  # words are all there is, in any case
            if not WIDE.search(text):
                text = text.lower()
            text = text.replace("\n", " ")
        else:
            text = "\0" + text.replace("\n", " \n")
        return b"".join(map(self.piece, text.split(" ")))

    def encode_all(self, texts: pa.Array) -> Iterator[bytes]:
        """encode() of each text, null as an empty one."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < len(texts):
            to = int(np.searchsorted(ends, before + TEXT_BYTES, "right"))
            if to > at:
                yield from self._encode_some(pc.fill_null(texts[at:to].cast(pa.string()), ""))
            else:  # a long text
                to = at + 1
                yield self.encode(texts[at].as_py())
            at, before = to, int(ends[to - 1])

    def _encode_some(self, texts: pa.Array) -> Iterator[bytes]:
        whole = pc.match_substring_regex(texts, WHOLE)
        cut = pc.if_else(whole, "", texts)
        if self.lower:
            cut = pc.if_else(pc.match_substring_regex(cut, WIDE.pattern), cut, pc.utf8_lower(cut))
            cut = pc.replace_substring(cut, "\n", " ")
        else:
            cut = pc.binary_join_element_wise("\0", pc.replace_substring(cut, "\n", " \n"), "")
        cut = pc.split_pattern(cut, " ")
        coded = cut.values.dictionary_encode()
        ids = pa.array(list(map(self.piece, coded.dictionary.to_numpy(zero_copy_only=False))), pa.binary()).take(coded.indices)
        _, ends, data = ids.buffers()
        ends = np.frombuffer(ends, np.int32)[cut.offsets.to_numpy()].tolist()
        data = memoryview(data) if data else b""
        for i, (odd, start, end) in enumerate(zip(whole.to_pylist(), ends, ends[1:])):
            yield self.plain(texts[i].as_py()) if odd else bytes(data[start:end])


_known: dict[tuple[str, str], Pieces] = {}


def encoder(path: str, dtype: str) -> Pieces:
    """encode(text) and encode_all(texts) give ids as bytes of the dtype, little-endian. One for each worker process and vocabulary."""
    key = (path, dtype)
    if key not in _known:
        _known[key] = Pieces(path, dtype)
    return _known[key]
