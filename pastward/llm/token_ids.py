"""Token ids of a public word-level BPE vocabulary, as packed little-endian 32-bit numbers.

The vocabulary lower-cases the text, drops white space and splits the rest into pieces (runs of letters,
single digits, runs of other characters), and never joins pieces. So the ids of a text are the ids of its pieces in
a row, and each distinct piece has to be encoded by the library only once per worker. Texts with characters
outside the range for which the split below is spelled out go through the library whole.
"""

from __future__ import annotations

import re
from array import array

END_ID = 2
VOCABULARY = "word_bpe_49k.json"

# Fixed values of the vocabulary: letters, digits and white space below U+0180, and its contractions.
_LETTERS = "a-zªµºß-öø-ſ"
_DIGITS = "0-9²³¹¼-¾"
_SPACES = "\t-\r \u0085 "
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_SPACES}{_LETTERS}{_DIGITS}]+")
_OTHER = re.compile("[^\\x00-įı-ſ]")
_CONTROL = re.compile("[\\x1c-\\x1f]")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes whole texts. Remembers the ids of the first ``room`` distinct words and pieces that it meets."""

    def __init__(self, path: str, room: int = 400_000):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.size = self.tokenizer.get_vocab_size()
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.bytes_of = {code: as_bytes.pre_tokenize_str(chr(code))[0][0] for code in range(0x180)}
        self.room = room
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.pieces.get(piece)
        if found is None:
            mapped = piece if piece.isascii() and piece.isalnum() else piece.translate(self.bytes_of)
            found = array("I", [token.id for token in self.model.tokenize(mapped)]).tobytes()
            if len(self.pieces) < self.room:
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self._piece(word)
        if word[-1] in ".,":
            start = word[:-1]
            if start.isalpha():
                return self._piece(start) + self._piece(word[-1])
        return b"".join(map(self._piece, _PIECE.findall(word)))

    def packed(self, text: str | None) -> bytes:
        """Ids of ``text`` (null: none), four bytes each."""
        if not text:
            return b""
        if not text.isascii() and _OTHER.search(text) or "<|" in text or _CONTROL.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        words, known = text.lower().split(), self.words
        try:
            return b"".join(map(known.__getitem__, words))
        except KeyError:
            new = {word: self._word(word) for word in words if word not in known}
            if len(known) < self.room:
                known.update(new)
                return b"".join(map(known.__getitem__, words))
            return b"".join([known.get(word) or new[word] for word in words])


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker process; made on first use and kept between tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
