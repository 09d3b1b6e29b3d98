"""Protocol buffers without a schema: the fields of a message, and what stands in the messages inside it."""

from __future__ import annotations

from collections.abc import Iterator

DEPTH = 6  # messages inside messages that are looked into


def fields(data: bytes) -> tuple[list[tuple[int, int, int | bytes]], bool]:
    """((number, wire type, value)s in order, whether all of data could be read). Groups end the reading."""
    out, at, end = [], 0, len(data)

    def number() -> int | None:
        nonlocal at
        n = 0
        for shift in range(0, 70, 7):
            if at >= end:
                return None
            n |= (data[at] & 127) << shift
            at += 1
            if data[at - 1] < 128:
                return n & (1 << 64) - 1
        return None

    while at < end:
        key = number()
        if key is None or key >> 3 == 0:
            return out, False
        kind = key & 7
        if kind == 0:
            value = number()
            if value is None:
                return out, False
        elif kind in (1, 2, 5):
            size = number() if kind == 2 else 8 if kind == 1 else 4
            if size is None or at + size > end:
                return out, False
            value = data[at : at + size]
            at += size
        else:
            return out, False
        out.append((key >> 3, kind, value))
    return out, True


def inside(data: bytes | None, *path: int) -> bytes | None:
    """Bytes of the first field of each number on the path, one inside the other; null where a step is missing or no bytes."""
    for n in path:
        found = next(((k, v) for f, k, v in fields(data)[0] if f == n), None) if data and fields(data)[1] else None
        if found is None or found[0] != 2:
            return None
        data = found[1]
    return data


def integers(data: bytes | None) -> dict[int, int]:
    """Integer fields by number, the last of repeated ones."""
    return {f: v for f, k, v in fields(data)[0] if k == 0} if data else {}


def readable(b: bytes | None) -> str | None:
    """Text without control characters other than tabs and line ends; null for nothing and for anything else."""
    if not b:
        return None
    try:
        s = b.decode()
    except UnicodeDecodeError:
        return None
    return None if any((c < " " and c not in "\t\n\r") or c == "\x7f" for c in s) else s


def strings(data: bytes | None, depth: int = DEPTH) -> Iterator[str]:
    """Readable strings in order; bytes that are none are looked into."""
    found, ok = fields(data or b"")
    for _, kind, value in found if ok else ():
        if kind == 2:
            s = readable(value)
            if s is not None:
                yield s
            elif depth:
                yield from strings(value, depth - 1)
