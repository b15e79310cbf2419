"""Outlook messages to mails: the compound file's streams by name, the mail's text and heads out of them."""

from __future__ import annotations

import struct

from .export import to_eml

#: Property streams of a message: subject, body, sender's address (three places), sender's name, recipients. Fixed values.
_SUBJECT, _BODY, _ADDRESSES, _NAME, _TO = "0037", "1000", ("5D01", "39FE", "0C1F"), "0C1A", "0E04"
_FREE = 0xFFFFFFFA


class MsgError(Exception):
    """The bytes are no readable compound file."""


def streams(data: bytes) -> dict[str, bytes]:
    """Streams in the root of a compound file, by name."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(data) < 512:
        raise MsgError("no compound file")
    size, small = 1 << struct.unpack_from("<H", data, 30)[0], 1 << struct.unpack_from("<H", data, 32)[0]
    directory, cutoff, mini, more = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0], struct.unpack_from("<I", data, 60)[0], struct.unpack_from("<I", data, 68)[0]
    sector = lambda i: data[(i + 1) * size : (i + 2) * size]
    numbers = lambda x: struct.unpack(f"<{len(x) // 4}I", x[: len(x) // 4 * 4])
    tables = [i for i in struct.unpack_from("<109I", data, 76) if i < _FREE]
    while more < _FREE and len(tables) <= len(data) // size:
        *rest, more = numbers(sector(more))
        tables += [i for i in rest if i < _FREE]
    nexts = [n for i in tables for n in numbers(sector(i))]

    def chain(at: int, links) -> list[int]:
        out = []
        while at < _FREE:
            if at >= len(links) or len(out) > len(links):
                raise MsgError("broken chain")
            out.append(at)
            at = links[at]
        return out

    whole = lambda at: b"".join(map(sector, chain(at, nexts)))
    rows, raw = [], whole(directory)
    for i in range(0, len(raw) - 127, 128):
        length, kind = struct.unpack_from("<H", raw, i + 64)[0], raw[i + 66]
        left, right, child = struct.unpack_from("<3I", raw, i + 68)
        start, held = struct.unpack_from("<IQ", raw, i + 116)
        rows.append((raw[i : i + max(0, length - 2)].decode("utf-16-le", "replace"), kind, left, right, child, start, held & 0xFFFFFFFF))
    if not rows:
        raise MsgError("no directory")
    packed, mini_nexts = whole(rows[0][5]), numbers(whole(mini)) if mini < _FREE else ()
    out, todo, seen = {}, [rows[0][4]], set()
    while todo:
        i = todo.pop()
        if i >= len(rows) or i in seen:
            continue
        seen.add(i)
        name, kind, left, right, _, start, held = rows[i]
        todo += [left, right]
        if kind == 2 and held:
            parts = b"".join(packed[k * small : (k + 1) * small] for k in chain(start, mini_nexts)) if held < cutoff else whole(start)
            out[name] = parts[:held]
        elif kind == 2:
            out[name] = b""
    return out


def msg_to_eml(data: bytes) -> bytes:
    """The message as a mail with subject, sender, recipients and plain text."""
    found = streams(data)

    def text(*codes: str) -> str:
        for code in codes:
            for kind, codec in (("001F", "utf-16-le"), ("001E", "cp1252")):
                if (x := found.get(f"__substg1.0_{code}{kind}")) is not None:
                    return x.decode(codec, "replace").rstrip("\0")
        return ""

    one_line = lambda x: " ".join(x.split())
    name, address = one_line(text(_NAME)), one_line(text(*_ADDRESSES))
    sender = f'"{name}" <{address}>' if name and "@" in address else address or name
    return to_eml(text(_BODY), one_line(text(_SUBJECT)), sender, one_line(text(_TO)))
