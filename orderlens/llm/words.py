"""Words of whole texts as byte strings, by a 256-byte table and ``bytes.split``."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split at once: a text of any length needs no more memory than this.
PIECE = 1 << 20


def word_table(lower: bool = True) -> bytes:
    """A table for ``bytes.translate``: digits, letters and all bytes of longer code points stay,
    A-Z are lowered, everything else becomes a blank."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for c in b"0123456789abcdefghijklmnopqrstuvwxyz":
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32 if lower else c
    return bytes(table)


TABLE = word_table()


def word_pieces(text: str | None, table: bytes = TABLE) -> Iterator[list[bytes]]:
    """The words of a text in order, in lists of at most ``PIECE`` bytes and one word.

    A cut is only made at a blank, so no word is torn.
    """
    if not text:
        return
    blank = text.encode("utf-8", "surrogatepass").translate(table)
    at = 0
    while len(blank) - at > PIECE:
        end = blank.find(b" ", at + PIECE)
        if end < 0:
            break
        yield blank[at:end].split()
        at = end
    yield blank[at:].split()
