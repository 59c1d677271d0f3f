"""Terms of whole texts as bytes: runs of letters (and digits) and of everything beyond ASCII, A-Z as a-z."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

#: Bytes counted at once; longer texts are cut between terms.
PIECE = 1 << 20


def _table(more: bytes = b"") -> bytes:
    """What each byte becomes: itself in a term, its small letter for A-Z, and a blank between terms."""
    keep = {*range(0x80, 0x100), *range(ord("a"), ord("z") + 1), *more}
    return bytes(b + 32 if ord("A") <= b <= ord("Z") else b if b in keep else 0x20 for b in range(256))


LETTERS = _table()
LETTERS_AND_DIGITS = _table(b"0123456789")


def pieces(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in lists of a bounded number of bytes (one longer term is whole)."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        part = text[at:end].translate(table)
        if end < len(text):
            cut = part.rfind(b" ")
            while cut < 0 and end < len(text):  # a term of more than a piece
                more = text[end : end + PIECE].translate(table)
                cut = len(part) + found if (found := more.find(b" ")) >= 0 else -1
                part, end = part + more, end + len(more)
            if cut >= 0:
                part, end = part[:cut], at + cut + 1  # the blank goes, so that every piece is shorter than what is left
        yield part.split()
        at = end


def counts(text: bytes | None, table: bytes) -> Counter[bytes]:
    """How often each term occurs in a text; none in null."""
    out: Counter[bytes] = Counter()
    for part in pieces(text or b"", table):
        out.update(part)
    return out
