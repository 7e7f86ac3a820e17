"""Cutting texts where no token of a byte-pair vocabulary can reach across.

A cut lies before a blank that follows a character that is no white space. Byte-level
patterns start a piece at such a blank in any case; for a vocabulary of pieces it holds
if no piece has a blank after another character, which `safe_blanks` finds out. What lies
between two cuts, a unit, is thus encoded by itself, and equal units only once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

SPACE_MARK = "▁"
BLANKS = " \n\t\r"
SEGMENT = 1 << 20  # characters of a text that are looked at together


def safe_blanks(pieces: Iterable[str]) -> str:
    """The blanks before which a cut crosses no piece (SPACE_MARK stands for the space)."""
    inside = {y for piece in pieces for x, y in zip(piece, piece[1:]) if not (x.isspace() or x == SPACE_MARK)}
    return "".join(y for y in BLANKS if (SPACE_MARK if y == " " else y) not in inside)


class Cutter:
    """Units of texts; equal to the whole text when joined."""

    def __init__(self, blanks: str) -> None:
        self.blanks = blanks
        if blanks:
            some = re.escape(blanks)
            self.plain = re.compile(f"[{some}]*[^{some}]+|[{some}]+")
            # White space that is no blank, and marks that some libraries take for a space.
            self.odd = re.compile(f"[^\\S{some}]|[᠎{SPACE_MARK}]")
            self.exact = re.compile(f"(?<=[^\\s᠎{SPACE_MARK}])(?=[{some}])")

    def units(self, text: str) -> list[str]:
        if not text or not self.blanks:
            return [text] if text else []
        if self.odd.search(text):
            return self.exact.split(text)
        return self.plain.findall(text)

    def segments(self, text: str, size: int = SEGMENT) -> Iterator[str]:
        """Runs of whole units, `size` characters and the rest of a unit long."""
        start = 0
        while self.blanks and len(text) - start > size:
            at = self.exact.search(text, start + size)
            if at is None:
                break
            yield text[start : at.start()]
            start = at.start()
        if start < len(text):
            yield text[start:] if start else text
