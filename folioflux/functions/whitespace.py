"""White space as the data model defines it: 29 characters, the same for tokens, trimming and \\s."""

from __future__ import annotations

#: Code points of the white-space characters. Fixed values.
SPACES = [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Code points at which a text is cut into lines. Fixed values.
LINE_ENDS = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]

WS_CHARS = "".join(map(chr, SPACES))


def _ranges(codes: list[int]) -> str:
    """Code points as the inside of a regex class, runs as ranges: a class of fewer parts is matched faster."""
    ends = [c for c in codes if c + 1 not in codes]
    starts = [c for c in codes if c - 1 not in codes]
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends))


#: The same as a regex class; the characters stand for themselves, so any engine reads it alike.
WS = f"[{_ranges(SPACES)}]"
NOT_WS = f"[^{_ranges(SPACES)}]"
#: One line end; a carriage return with its line feed counts once.
LINE_END = "\r\n|[" + "".join(map(chr, LINE_ENDS)) + "]"
