"""Token ids of whole texts, by the public tokenizer libraries.

Encoding is remembered by piece. A piece is a stretch of text that no token of
the vocabulary can cross, so that the ids of a text are those of its pieces in
order. A text whose white space or special strings make that doubtful is given
to the library whole. The memory of each Python worker is bounded: by the
pieces that it remembers and by the characters that it works on at once.
"""

from __future__ import annotations

import os
import string
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that no token of the vocabularies joins to letters before them.
_MARKS = frozenset(".,;:!?")
#: After a letter a run of these is a pre-token of its own. An apostrophe may begin one with letters.
_TAIL = string.punctuation.replace("'", "")
_CODECS: dict[tuple[str, str], "PieceCodec"] = {}


def byte_symbols() -> dict[int, str]:
    """The printable symbol that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def shrink(known: dict) -> None:
    """Forget the newer half. What came first is, as a rule, what is frequent."""
    for key in list(known)[len(known) // 2 :]:
        del known[key]


class PieceCodec:
    """``encode(text)`` gives the ids as little-endian unsigned 32-bit bytes.

    ``style`` is ``spaced`` if a token may begin with one space (byte-level
    BPE) and ``words`` if white space is dropped.
    """

    def __init__(self, path: str, style: str, limit: int = 900_000, block: int = 6_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.spaced, self.limit, self.block = style == "spaced", limit, block
        self.known: dict[str, bytes] = {"": b""}
        self.marks: dict[str, bytes] = {}
        self.letters: dict[str, bool] = {}
        self.symbols = byte_symbols()

    @classmethod
    def shared(cls, path: str, style: str, limit: int, block: int = 6_000_000) -> "PieceCodec":
        """One codec for each Python worker, with the bounds of the latest call."""
        key = (path, style)
        if key not in _CODECS:
            _CODECS[key] = cls(path, style, limit, block)
        codec = _CODECS[key]
        codec.limit, codec.block = limit, block
        return codec

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def spread(self, text: str) -> str | None:
        """The text with one space between its pieces, or None if it must be encoded whole.

        In the spaced style all pieces but the first stand for a space and
        themselves; those that begin with a line break stand for themselves.
        """
        if "<|" in text or not text.replace("\n", "").isprintable():
            return None
        if not self.spaced:
            return text.replace("\n", " ")
        if "  " in text or " \n" in text or "\n " in text or text[-1:] == " ":
            return None
        # a single line break is a token run of its own
        return text if "\n\n" in text else text.replace("\n", " \n")

    def pieces(self, text: str) -> list[str] | None:
        flat = self.spread(text)
        return None if flat is None else flat.split(" ")

    def _letters(self, piece: str, lead: bool) -> str | None:
        """The model's symbols of a piece of Latin letters, which is one pre-token."""
        if not piece.isalpha():
            return None
        if piece.isascii():  # each stands for itself
            return ("\u0120" if lead else "") + piece if self.spaced else piece.lower()
        if piece > "\u00ff" or max(piece) > "\u00ff":
            return None
        if self.spaced:
            return ("\u0120" if lead else "") + piece.encode().decode("latin-1").translate(self.symbols)
        return piece.lower().encode().decode("latin-1").translate(self.symbols)

    def learn(self, pieces: set[str]) -> None:
        """Remember ``pieces``; marks after a letter are encoded by themselves."""
        known, lead = self.known, " " if self.spaced else ""
        while len(known) > self.limit:
            shrink(known)
        marked = {p: stem for p in pieces if (stem := p.rstrip(_TAIL)) != p and self._ends_in_letter(stem[-1:])}
        model, rest = self.tokenizer.model, []
        for p in pieces.difference(marked).union(marked.values()):
            if p not in known:
                line = p[:1] == "\n"
                symbols = self._letters(p[1:] if line else p, not line)
                if symbols is None:
                    rest.append(p)
                else:
                    known[p] = (self._mark("\n") if line else b"") + array("I", [t.id for t in model.tokenize(symbols)]).tobytes()
        for at in range(0, len(rest), 1000):  # an encoding takes far more memory than its ids
            some = rest[at : at + 1000]
            asked = [p if p[:1] == "\n" else lead + p for p in some]
            for p, e in zip(some, self.tokenizer.encode_batch(asked, add_special_tokens=False)):
                known[p] = array("I", e.ids).tobytes()
        for p, stem in marked.items():
            known[p] = known[stem] + self._mark(p[len(stem) :])

    def _ends_in_letter(self, char: str) -> bool:
        """Whether a letter still ends in one when the vocabulary has normalised it: a combining mark joins marks after it."""
        found = self.letters.get(char)
        if found is None:
            normalizer = self.tokenizer.normalizer
            plain = normalizer.normalize_str(char) if normalizer else char
            found = self.letters[char] = char.isalpha() and plain[-1:].isalpha()
        return found

    def _mark(self, mark: str) -> bytes:
        found = self.marks.get(mark)
        if found is None:
            if len(self.marks) > 10_000:
                shrink(self.marks)
            found = self.marks[mark] = self.whole(mark)
        return found

    def encode(self, text: str | None) -> bytes:
        """The ids of one text."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text."""
        out: list[bytes] = []
        for block in blocks(texts, self.block):
            flat = [self.spread(t) if t else "" for t in block]
            names, codes, ends = split_unique(flat)
            got = list(map(self.known.get, names))
            if None in got:
                new = [i for i, v in enumerate(got) if v is None]
                self.learn({names[i] for i in new})
                for i in new:
                    got[i] = self.known[names[i]]
            at, body = joined(got, codes)
            for text, row, a, b in zip(block, flat, ends, ends[1:]):
                if row is None:
                    out.append(self.whole(text))
                elif self.spaced and row:
                    head = names[codes[a]]
                    out.append(b"".join([self.whole(head) if head else b"", body[at[a + 1] : at[b]]]))
                else:
                    out.append(bytes(body[at[a] : at[b]]))
            del flat, names, codes, got, at, body
            pa.default_memory_pool().release_unused()
        return out


def blocks(texts: list[str | None], chars: int = 6_000_000) -> Iterator[list[str | None]]:
    """Consecutive texts of about so many characters together."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def split_unique(flat: list[str | None]) -> tuple[list[str], np.ndarray, list[int]]:
    """Distinct pieces, the piece numbers of all texts, and where each text's begin."""
    cut = pc.split_pattern(pa.array([r or "" for r in flat], pa.large_string()), " ")
    coded = cut.values.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes ten times as long
    return names, coded.indices.to_numpy(zero_copy_only=False), cut.offsets.to_pylist()


def joined(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """The parts that ``codes`` number, one after the other, and where each begins."""
    taken = pa.array(parts, pa.large_binary()).take(pa.array(codes))
    _, at, body = taken.buffers()
    return np.frombuffer(at, np.int64, len(codes) + 1), memoryview(body or b"")


def public_path(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
