"""Words of whole texts as bytes, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

#: Texts are cut at white space into pieces of about so many bytes before they become word lists.
PIECE = 1 << 20


def word_lists(text: bytes, piece: int = PIECE) -> Iterator[list[bytes]]:
    r"""All words ``[^\x20\x09-\x0D]+`` of a UTF-8 text in order (``bytes.split`` cuts at just these bytes)."""
    if len(text) <= piece:
        yield text.split()
        return
    at = 0
    while at < len(text):
        end = min(len(text), at + piece)
        while end < len(text) and text[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        yield text[at:end].split()
        at = end
