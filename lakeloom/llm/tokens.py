"""Token ids of texts by a public tokenizer file, piece by piece and remembered."""

from __future__ import annotations

from tokenizers import Tokenizer

from .common import process_store

#: Pieces of text remembered in a worker; beyond it the memory is emptied and fills again.
MEMORY = 1_200_000
#: Marks that a word may end in; as a run they are one unit of the tokenizer.
MARKS = '.,!?;:*%$&#|+-_/()"'


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(odd)}


class WordMemory(dict):
    """Maps a piece of text without spaces to its ids as little-endian 32-bit integers.

    Tokens never reach over white space, so a text's ids are those of its pieces in a row.
    A piece that is Latin letters, or letters and then marks, goes to the merges directly
    and in lower case; any other piece goes through the whole library.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.units: dict[str, bytes] = {}

    def unit(self, word: str) -> bytes:
        found = self.units.get(word)
        if found is None:
            if len(self.units) >= MEMORY:
                self.units.clear()
            shown = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
            found = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(shown))
            self.units[word] = found
        return found

    def __missing__(self, piece: str) -> bytes:
        core = piece.rstrip(MARKS)
        plain = core.isalpha() and (core.isascii() or (max(core) < "ɐ" and "İ" not in core))
        if plain:
            ids = self.unit(core.lower())
            if len(core) < len(piece):
                ids += self.unit(piece[len(core) :])
        else:
            found = self.tokenizer.encode(piece, add_special_tokens=False).ids
            ids = b"".join(i.to_bytes(4, "little") for i in found)
        if len(self) >= MEMORY:
            self.clear()
        self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        """The text between spaces and line ends; separators are one character each."""
        return text.replace("\n", " ").split(" ")

    def ids(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.pieces(text)))


def word_memory(path: str) -> WordMemory:
    """The worker's memory for the tokenizer file at `path`."""
    return process_store(f"words:{path}", lambda: WordMemory(path))
