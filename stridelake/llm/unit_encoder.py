"""Byte-level BPE of whole texts through the tokenizers library, one call per distinct word instead of per occurrence.

The pre-tokenizer of a byte-level BPE never joins characters across a single blank: a space opens the next pre-token, a
line feed stands alone. So a text falls into units that begin at its spaces and line feeds, and its ids are those of its
units in a row. The exceptions are runs of three blanks or more, and of two at the end, whose match can reach over a
unit's end; texts with such runs, or with a special token's text, go to the library whole.

A unit that is letters and then ASCII marks is two pre-tokens, letters and marks; those parts, which most units are made
of, meet the library's BPE model without its pattern. All other units go through the library's own pre-tokenizer.
"""

from __future__ import annotations

import re
import string
from array import array
from functools import lru_cache

#: Runs of blanks that may be matched across units.
LONG_BLANKS = re.compile(r"\s\s(?:\s|\Z)")
#: Distinct units and parts that are remembered; then the memory starts anew.
REMEMBERED = 500_000


def _spelling() -> dict[int, str]:
    """The character that stands for each byte: itself where it is visible, else the next one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(hidden)}


SPELT = _spelling()


@lru_cache(maxsize=4)
def unit_encoder(path: str, code: str = "H", spans: bool = False) -> UnitEncoder:
    """The worker process's own encoder, so that what it remembers outlives a task."""
    return UnitEncoder(path, code, spans)


class _Known(dict):
    """Values of pieces that have `lead` in front (or the line feed that they begin with); made when first asked for."""

    def __init__(self, encoder: UnitEncoder, lead: str):
        self.encoder, self.lead = encoder, lead

    def __missing__(self, piece: str):
        encoder, word = self.encoder, piece.rstrip(string.punctuation)
        if self.lead and piece[:1] == "\n":
            value = encoder.joined(encoder.feed, encoder.head[piece[1:]], 1) if LONG_BLANKS.search(piece) is None else encoder.alone(piece)
        elif not word.isalpha():
            value = encoder.alone(self.lead + piece)
        elif len(word) < len(piece):
            value = encoder.joined(self[word], encoder.marks[piece[len(word) :]], len(word) + len(self.lead))
        else:
            value = encoder.part(self.lead + piece)
        self[piece] = value
        return value


class _Marks(dict):
    def __init__(self, encoder: UnitEncoder):
        self.encoder = encoder

    def __missing__(self, marks: str):
        value = self[marks] = self.encoder.part(marks)
        return value


class UnitEncoder:
    """ids(texts): each text's ids, as native bytes of `code` ('H' or 'I'); spans(texts): its tokens' character spans."""

    def __init__(self, path: str, code: str = "H", spans: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, processors

        self.library, self.code, self.with_spans = Tokenizer.from_file(path), code, spans
        if spans:  # a token of blanks keeps its own place
            self.library.post_processor = processors.ByteLevel(trim_offsets=False)
        self.model = self.library.model
        # the library cuts texts at these before anything else
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.feed = self.alone("\n")
        self.forget()

    def forget(self) -> None:
        self.tail, self.head, self.marks = _Known(self, " "), _Known(self, ""), _Marks(self)

    def joined(self, a, b, shift: int):
        import numpy as np

        if not self.with_spans:
            return a + b
        return a[0] + b[0], a[1] + (np.frombuffer(b[1], "<i4") + np.int32(shift)).tobytes()

    def alone(self, text: str):
        """Value of a unit or text by the whole of the library."""
        e = self.library.encode(text, add_special_tokens=False)
        if self.with_spans:
            return len(e.ids), array("i", [x for s in e.offsets for x in s]).tobytes()
        return array(self.code, e.ids).tobytes()

    def part(self, text: str):
        """Value of one pre-token by the library's model alone."""
        if text.isascii():
            tokens = self.model.tokenize(SPELT[32] + text[1:] if text[0] == " " else text)
            if self.with_spans:
                return self._ascii_spans(tokens)
        elif self.with_spans:
            return self.alone(text)
        else:
            tokens = self.model.tokenize(text.encode().decode("latin-1").translate(SPELT))
        return array(self.code, [t.id for t in tokens]).tobytes()

    @staticmethod
    def _ascii_spans(tokens):
        out, at = array("i"), 0
        for t in tokens:
            out.append(at)
            at += len(t.value)
            out.append(at)
        return len(tokens), out.tobytes()

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text; None where it has to be encoded whole."""
        if LONG_BLANKS.search(text) or any(t in text for t in self.special):
            return None
        return text.replace("\n", " \n").split(" ")

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.tail) > REMEMBERED:
            self.forget()
        tail, out = self.tail.__getitem__, []
        for text in texts:
            if (pieces := self._cut(text)) is None:
                out.append(self.alone(text))
            else:
                first = self.head[pieces.pop(0)]
                out.append(first + b"".join(map(tail, pieces)))
        return out

    def spans(self, texts: list[str]):
        """Per text an int32 array (tokens, 2) of the character spans that the library would give for the whole text."""
        import numpy as np

        if len(self.tail) > REMEMBERED // 2:
            self.forget()
        tail, out = self.tail.__getitem__, []
        for text in texts:
            if (pieces := self._cut(text)) is None:
                out.append(np.frombuffer(self.alone(text)[1], "<i4").reshape(-1, 2))
                continue
            counts, parts = zip(self.head[pieces[0]], *map(tail, pieces[1:]))
            spans = np.frombuffer(b"".join(parts), "<i4").reshape(-1, 2)
            # a piece has its space or line feed in front; the first and those with a line feed are as long as they look
            lengths = np.fromiter((len(w) + (w[:1] != "\n") for w in pieces), np.int64, len(pieces))
            lengths[0] = len(pieces[0])
            out.append(spans + np.repeat(np.cumsum(lengths) - lengths, counts).astype("<i4")[:, None])
        return out
