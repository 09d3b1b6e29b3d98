"""Media columns: payloads as progressive JPEG files, read back into coefficients and full-resolution RGB tensors.

A file's 8x8 blocks hold 64 payload bytes each, one to a quantised coefficient, so nothing is lost. It is written
in scans by spectral selection and successive approximation, with a restart marker after each block: a reader
takes all restart intervals of all files of a batch abreast, a numpy lane for each. The reader accumulates any
such scans, runs of zeros, end-of-band runs and newly non-zero coefficients included.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from bisect import bisect_left
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, table, utf8, with_fields

BLOCK = 64
_ADD = 2  # coefficient = byte + 2: never 0 or 1, so that the first scans find every coefficient non-zero
_CHUNK = 2 << 20  # payload bytes written or read abreast
_LANES = 1 << 15

#: Fixed values of JPEG: the zigzag order, and the conversion from YCbCr.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))))
_SOI, _EOI, _SOF2, _DHT, _DQT, _DRI, _SOS, _COM = 0xD8, 0xD9, 0xC2, 0xC4, 0xDB, 0xDD, 0xDA, 0xFE
#: (first coefficient, last, bits known before, bits left out) of the scans of each component, in order.
SCANS = ((0, 0, 0, 1), (1, 5, 0, 1), (6, 63, 0, 1), (0, 0, 1, 0), (1, 63, 1, 0))
_SAMPLING = ((1, 2, 2), (2, 1, 1), (3, 1, 1))  # component, horizontal, vertical: chroma at half size

#: Huffman tables: frequent symbols have 4 bits, the others 9.
_DC_SYMBOLS = {4: list(range(12))}
_AC_SYMBOLS = {4: [0x00, *range(1, 9)], 9: [0x09, 0x0A, 0xF0, *(r << 4 | s for r in range(1, 16) for s in range(1, 11)), 0x10]}


def _codes(symbols: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by symbol, canonical."""
    code, length, nxt = np.zeros(256, np.int64), np.zeros(256, np.int64), 0
    for n in range(1, 17):
        for s in symbols.get(n, ()):
            code[s], length[s] = nxt, n
            nxt += 1
        nxt <<= 1
    return code, length


def _lookup(symbols: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, length) by the next 16 bits."""
    code, length = _codes(symbols)
    sym, bits = np.zeros(1 << 16, np.uint8), np.zeros(1 << 16, np.uint8)
    for s in np.flatnonzero(length):
        lo = int(code[s]) << (16 - int(length[s]))
        hi = lo + (1 << (16 - int(length[s])))
        sym[lo:hi], bits[lo:hi] = s, length[s]
    return sym, bits


_SIZE = np.array([int(i).bit_length() for i in range(2048)])


# -- writing ------------------------------------------------------------------------------------


def _pack(val: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (lanes, tokens) of at most 12 bits each, laid end to end in each lane and filled up with ones, as bytes; each lane's size."""
    if val.shape[1] % 2:
        val, bits = np.pad(val, ((0, 0), (0, 1))), np.pad(bits, ((0, 0), (0, 1)))
    val, bits = val[:, ::2] << bits[:, 1::2] | val[:, 1::2], bits[:, ::2] + bits[:, 1::2]
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) >> 3
    at = np.cumsum(size) - size
    pos = (ends - bits) + (at << 3)[:, None]
    fill = (size << 3) - ends[:, -1]
    word = (val << (32 - bits - (pos & 7))).ravel()
    first, total = (pos >> 3).ravel(), int(size.sum())
    out = np.zeros(total + 4)
    for k in range(4):
        out += np.bincount(first + k, weights=(word >> (24 - 8 * k)) & 255, minlength=total + 4)[: total + 4]
    out = out[:total].astype(np.uint8)
    out[at + size - 1] |= ((1 << fill) - 1).astype(np.uint8)
    return out, size


def _marked(out: np.ndarray, size: np.ndarray, turn: np.ndarray) -> tuple[bytes, list[int]]:
    """The lanes' bytes stuffed, with a restart marker, numbered by the lane's turn in its scan, after each lane; the start of each lane, and the end."""
    at, total = np.cumsum(size) - size, len(out)
    ff = out == 255
    before = np.cumsum(ff) - ff
    starts = at + before[at] + 2 * np.arange(len(size))
    res = np.zeros(total + int(ff.sum()) + 2 * len(size), np.uint8)
    res[np.arange(total) + before + 2 * np.repeat(np.arange(len(size)), size)] = out
    ends = np.append(starts[1:], len(res))
    res[ends - 2], res[ends - 1] = 255, 0xD0 + turn % 8
    return res.tobytes(), [*starts.tolist(), len(res)]


def _segment(code: int, body: bytes) -> bytes:
    return bytes([255, code]) + (len(body) + 2).to_bytes(2, "big") + body


def _table_body(kind: int, symbols: dict[int, list[int]]) -> bytes:
    return bytes([kind, *(len(symbols.get(n, ())) for n in range(1, 17)), *(s for n in sorted(symbols) for s in symbols[n])])


@lru_cache(256)
def _scan_head(comp: int, first: int, last: int, before: int, left: int) -> bytes:
    return _segment(_SOS, bytes([1, comp, 0, first, last, before << 4 | left]))


_TABLES = _segment(_DQT, bytes([0] + [1] * 64)) + _segment(_DHT, _table_body(0x00, _DC_SYMBOLS) + _table_body(0x10, _AC_SYMBOLS)) + _segment(_DRI, b"\x00\x01")


def _geometry(n_bytes: int) -> tuple[int, int, int]:
    """Blocks, and the image's size in units of 16 by 16."""
    mcus = -(-n_bytes // (6 * BLOCK))
    wide = math.isqrt(mcus - 1) + 1
    return n_bytes // BLOCK, wide, -(-mcus // wide)


def write(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload, a positive multiple of 64 bytes; the payload's length is in a comment."""
    shapes = [_geometry(len(p)) for p in payloads]
    blocks = [6 * w * h for _, w, h in shapes]
    at = np.cumsum(blocks) - blocks
    coef = np.zeros((sum(blocks), BLOCK), np.int32)
    for p, a, (n, _, _) in zip(payloads, at, shapes, strict=True):
        coef[a : a + n] = np.frombuffer(p, np.uint8).reshape(-1, BLOCK)
    coef += _ADD
    scan_sizes = np.array([i * j * w * h for _, w, h in shapes for _, i, j in _SAMPLING])
    turn = np.arange(len(coef)) - np.repeat(np.cumsum(scan_sizes) - scan_sizes, scan_sizes)
    dc_code, dc_len = _codes(_DC_SYMBOLS)
    ac_code, ac_len = _codes(_AC_SYMBOLS)
    streams = []
    for first, last, before, left in SCANS:
        c = coef[:, first : last + 1]
        if before:  # one more bit of each coefficient, after an end of band where it is no DC scan
            head = int(ac_len[0]) if first else 0
            bits = np.ones((len(c), -(-(head + c.shape[1]) // 8) * 8), np.uint8)
            bits[:, :head] = [int(ac_code[0]) >> (head - 1 - i) & 1 for i in range(head)]
            bits[:, head : head + c.shape[1]] = c & 1
            out = np.packbits(bits, axis=1)
            streams.append(_marked(out.ravel(), np.full(len(out), out.shape[1]), turn))
        else:
            v = c >> left
            s = _SIZE[v]
            code, length = (ac_code, ac_len) if first else (dc_code, dc_len)
            streams.append(_marked(*_pack(code[s] << s | v, length[s] + s), turn))
    out = []
    for p, a, (n, w, h) in zip(payloads, at, shapes, strict=True):
        frame = b"\x08" + (16 * h).to_bytes(2, "big") + (16 * w).to_bytes(2, "big") + bytes([3] + [x for c, i, j in _SAMPLING for x in (c, i << 4 | j, 0)])
        parts = [bytes([255, _SOI]), _segment(_COM, b"%d" % len(p)), _TABLES[: 2 + 67], _segment(_SOF2, frame), _TABLES[2 + 67 :]]
        for (first, last, before, left), (data, starts) in zip(SCANS, streams, strict=True):
            b = int(a)
            for comp, i, j in _SAMPLING:
                e = b + i * j * w * h
                parts += [_scan_head(comp, first, last, before, left), data[starts[b] : starts[e] - 2]]
                b = e
        parts.append(bytes([255, _EOI]))
        out.append(b"".join(parts))
    return out


# -- reading ------------------------------------------------------------------------------------


class _Bits:
    """The next bits of many lanes of one byte array."""

    def __init__(self, data: np.ndarray):
        d = np.concatenate([data, np.zeros(64, np.uint8)]).astype(np.uint32)
        self.word = d[:-3] << np.uint32(24) | d[1:-2] << np.uint32(16) | d[2:-1] << np.uint32(8) | d[3:]

    def __call__(self, pos: np.ndarray) -> np.ndarray:
        """32 bits of which the first 25 are the next; the rest are not theirs."""
        return self.word[pos >> 3] << (pos & 7).astype(np.uint32)


def _top(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The first n (0 to 16) bits."""
    return ((x >> np.uint32(1)) >> (31 - n).astype(np.uint32)).astype(np.int64)


def _extend(v: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)


def _whole(symbols: dict[int, list[int]], left: int) -> tuple[np.ndarray, np.ndarray]:
    """(value, bits) by the next 16 bits, where these hold a code without a run and all of its value; else 0 bits."""
    sym, n = (t.astype(np.int64) for t in _lookup(symbols))
    ok = (n > 0) & (sym > 0) & (sym < 16) & (n + sym <= 16)
    v = np.arange(1 << 16) << 16 >> np.where(ok, 32 - n - sym, 0) & ((1 << np.where(ok, sym, 0)) - 1)
    return (_extend(v, sym) << left).astype(np.int32), np.where(ok, n + sym, 0).astype(np.uint8)


def _ac_plain(bits, pos, coef, rows, first, last, whole) -> bool:
    """The first scan of a band where every coefficient has a code of its own; False, with nothing done, where that isn't so."""
    out = np.empty((last - first + 1, len(pos)), np.int32)
    for k in range(len(out)):
        x = bits(pos) >> np.uint32(16)
        n = whole[1][x]
        if not n.all():
            return False
        out[k] = whole[0][x]
        pos = pos + n
    coef[rows[:, 0], first : last + 1] = out.T
    return True


def _dc_first(bits, pos, coef, rows, left, tab):
    pred = np.zeros(len(pos), np.int64)
    for j in range(rows.shape[1]):
        ok = rows[:, j] >= 0
        x = bits(pos)
        sym = tab[0][x >> np.uint32(16)].astype(np.int64)
        n = tab[1][x >> np.uint32(16)].astype(np.int64)
        v = _top(bits(pos + n), sym)
        pred = pred + np.where(ok, _extend(v, sym), 0)
        coef[rows[ok, j], 0] = pred[ok] << left
        pos = pos + np.where(ok, n + sym, 0)


def _dc_next(bits, pos, coef, rows, left):
    for j in range(rows.shape[1]):
        ok = rows[:, j] >= 0
        coef[rows[ok, j], 0] |= (bits(pos)[ok] >> np.uint32(31)).astype(coef.dtype) << left
        pos = pos + ok


def _ac_first(bits, pos, coef, rows, first, last, left, tab):
    skip = np.zeros(len(pos), np.int64)  # blocks left of a run of ended bands
    for j in range(rows.shape[1]):
        live = rows[:, j] >= 0
        skipped = live & (skip > 0)
        skip = skip - skipped
        lane = np.flatnonzero(live & ~skipped)
        k, p, row = np.full(len(lane), first), pos[lane], rows[lane, j]
        while len(lane):
            x = bits(p)
            top = x >> np.uint32(16)
            sym, n = tab[0][top].astype(np.int64), tab[1][top].astype(np.int64)
            s, r = sym & 15, sym >> 4
            v = _top(x << n.astype(np.uint32), s)  # a code and its bits are 25 at most: 16 and 10 never meet here
            long = n + s > 25
            if long.any():
                v = np.where(long, _top(bits(p + n), s), v)
            p = p + n + s
            k = k + r
            put = s > 0
            if put.all():
                coef[row, k] = _extend(v, s) << left
            else:
                coef[row[put], k[put]] = _extend(v[put], s[put]) << left
            end = ~put & (r < 15)
            if end.any():
                run = np.where(end, (1 << r) - 1 + _top(bits(p), np.where(end, r, 0)), 0)
                p = p + np.where(end, r, 0)
                skip[lane[end]] = run[end]
            k = k + 1
            go = ~end & (k <= last)
            if not go.all():
                pos[lane[~go]] = p[~go]
                lane, k, p, row = lane[go], k[go], p[go], row[go]


def _ac_next(bits, pos, coef, rows, first, last, left, tab):
    """Each coefficient's next bit; symbols tell of the newly non-zero ones, `run` zeros on."""
    skip = np.zeros(len(pos), np.int64)
    for j in range(rows.shape[1]):
        lane = np.flatnonzero(rows[:, j] >= 0)
        row, p = rows[lane, j], pos[lane]
        over = skip[lane] > 0  # the band has ended: only bits of non-zero coefficients follow
        skip[lane] -= over
        ask, run, new = ~over, np.zeros(len(lane), np.int64), np.zeros(len(lane), np.int64)
        c = coef[row, first : last + 1]
        if c.all():  # nothing can become non-zero: the band ends at once, and a bit of each follows
            sym, n = (t[bits(p) >> np.uint32(16)].astype(np.int64) for t in tab)
            if not (ask & (sym != 0)).any():
                p = p + ask * n
                for k in range(0, c.shape[1], 24):
                    part = c[:, k : k + 24]
                    more = bits(p + k)[:, None] >> np.arange(31, 31 - part.shape[1], -1, dtype=np.uint32) & np.uint32(1)
                    part += np.sign(part) * (more.astype(np.int32) << left)
                coef[row, first : last + 1] = c
                pos[lane] = p + c.shape[1]
                continue
        for k in range(first, last + 1):
            if ask.any():
                a = np.flatnonzero(ask)
                x = bits(p[a])
                sym, n = tab[0][x >> np.uint32(16)].astype(np.int64), tab[1][x >> np.uint32(16)].astype(np.int64)
                s, r = sym & 15, sym >> 4
                q = p[a] + n
                sign = (bits(q) >> np.uint32(31)).astype(np.int64)
                new[a] = np.where(s > 0, 2 * sign - 1, 0)
                q = q + (s > 0)
                end = (s == 0) & (r < 15)
                skip[lane[a[end]]] = (1 << r[end]) - 1 + _top(bits(q), np.where(end, r, 0))[end]
                over[a[end]] = True
                p[a] = q + np.where(end, r, 0)
                run[a] = r
                ask = np.zeros(len(lane), bool)
            c = coef[row, k]
            known = c != 0
            bit = (bits(p) >> np.uint32(31)).astype(bool) & known
            coef[row, k] = c + (np.sign(c) * bit << left).astype(coef.dtype)
            p = p + known
            zero = ~known & ~over
            if zero.any():
                here = zero & (run == 0)
                put = here & (new != 0)
                coef[row[put], k] = (new[put] << left).astype(coef.dtype)
                ask = here
                run = run - (zero & ~here)
        pos[lane] = p


@lru_cache(64)
def _split_tables(body: bytes) -> dict[int, bytes]:
    out = {}
    while body:
        n = 17 + sum(body[1:17])
        out[body[0]], body = body[1:n], body[n:]
    return out


def _frame(body: bytes, base: int) -> dict:
    h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    comps = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15) for i in range(body[5])}
    hm, vm = (max(c[i] for c in comps.values()) for i in (0, 1))
    size = {c: (-(-w * i // (8 * hm)), -(-h * j // (8 * vm))) for c, (i, j) in comps.items()}
    at, offset = {}, base
    for c, (bw, bh) in size.items():
        at[c] = (offset, bw * bh)
        offset += bw * bh
    return {"size": (h, w), "comps": size, "at": at, "blocks": (base, offset)}


def _walk(data: bytes, stops: list[int], starts: list[int], ends: list[int]) -> tuple[list[dict], dict[tuple, list], int]:
    """Walks the markers of files laid end to end: their shapes; scans by kind, each with its place, end, first block and blocks; all blocks."""
    shapes, scans, base, turn = [], {}, 0, 0
    for a, z in zip(starts, ends, strict=True):
        shape, tables, every, comment, at = None, {}, 0, b"", a + 2
        while at < z:
            mark = data[at + 1]
            if mark == _EOI:
                break
            size = data[at + 2] << 8 | data[at + 3]
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if mark == _SOS:
                if shape is None or body[0] != 1:
                    raise ValueError("only progressive files with scans of one component are read")
                end = stops[bisect_left(stops, at)]
                first, last, bits = body[3], body[4], body[5]
                offset, n = shape["at"][body[1]]
                coded = first or not bits >> 4
                kind = (first, last, bits >> 4, bits & 15, tables.get(0x10 | body[2] & 15 if first else body[2] >> 4, b"") if coded else b"", every or n)
                scans.setdefault(kind, []).append((at, end, offset, n, turn))
                turn += 1
                at = end
            elif mark == _COM:
                comment = body
            elif mark == _DRI:
                every = int.from_bytes(body, "big")
            elif mark == _DHT:
                tables = tables | _split_tables(body)
            elif mark == _SOF2:
                shape = _frame(body, base)
                base = shape["blocks"][1]
        shapes.append(shape | {"comment": comment})
    return shapes, scans, base


@lru_cache(64)
def _symbols(tab: bytes, left: int):
    symbols = {k + 1: list(tab[16 + sum(tab[:k]) : 16 + sum(tab[: k + 1])]) for k in range(16)} if tab else {}
    return _lookup(symbols), _whole(symbols, left)


def read(files: list[bytes]) -> tuple[np.ndarray, list[dict]]:
    """Coefficients (blocks, 64) in zigzag order of all files' blocks, and each file's shape."""
    ends = np.cumsum([len(f) for f in files])
    data = b"".join(files)
    arr = np.frombuffer(data, np.uint8)
    ff = np.flatnonzero(arr[:-1] == 255)
    code = arr[ff + 1]
    rst = (code >= 0xD0) & (code <= 0xD7)
    restarts = ff[rst]
    shapes, scans, n_blocks = _walk(data, ff[(code != 0) & (code != 255) & ~rst].tolist(), (ends - [len(f) for f in files]).tolist(), ends.tolist())
    stuffed = np.zeros(len(arr), bool)
    stuffed[ff[code == 0] + 1] = True
    gone = np.cumsum(stuffed, dtype=np.int32)
    bits = _Bits(arr[~stuffed])
    coef = np.zeros((n_blocks, BLOCK), np.int32)
    # scans of one kind are read abreast; kinds come in the order in which bits are told
    for (first, last, before, left, tab, every), own in sorted(scans.items(), key=lambda g: (g[0][2] > 0, -g[0][3], g[1][0][4])):
        at, end, offset, n, _ = (np.array(x) for x in zip(*own, strict=True))
        lo = np.searchsorted(restarts, at)
        lanes = np.searchsorted(restarts, end) - lo + 1
        scan = np.repeat(np.arange(len(at)), lanes)
        turn = np.arange(len(scan)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start = np.where(turn == 0, at[scan], restarts[np.minimum(lo[scan] + turn - 1, len(restarts) - 1)] + 2 if len(restarts) else 0)
        block = turn[:, None] * every + np.arange(every)[None, :]
        rows = np.where(block < n[scan][:, None], block + offset[scan][:, None], -1)
        pos = (start - gone[start]).astype(np.int64) * 8
        look, whole = _symbols(tab, left)
        for i in range(0, len(pos), _LANES):
            p, r = pos[i : i + _LANES].copy(), rows[i : i + _LANES]
            if first and not before and every == 1 and _ac_plain(bits, p, coef, r, first, last, whole):
                continue
            if first == 0:
                _dc_next(bits, p, coef, r, left) if before else _dc_first(bits, p, coef, r, left, look)
            else:
                (_ac_next if before else _ac_first)(bits, p, coef, r, first, last, left, look)
    return coef, shapes


def payload(coef: np.ndarray, shape: dict) -> bytes:
    """The payload that write() put into the blocks of a file."""
    n, a = int(shape["comment"]), shape["blocks"][0]
    return (coef[a : a + n // BLOCK] - _ADD).astype(np.uint8).tobytes()


def _cosines() -> np.ndarray:
    """(64 coefficients in zigzag order, 64 samples) of the inverse transform."""
    x = np.arange(8)
    c = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) * np.where(x == 0, np.sqrt(0.125), 0.5)[:, None]
    return np.einsum("ux,vy->uvxy", c, c).reshape(64, 64)[ZIGZAG].astype(np.float32)


_COSINES = _cosines()


def tensors(coef: np.ndarray, shapes: list[dict]) -> list[np.ndarray]:
    """Full-resolution RGB (height, width, 3) of each file: inverse transform, chroma upsampled by repetition."""
    samples = np.clip(np.rint(coef.astype(np.float32) @ _COSINES + 128), 0, 255).astype(np.float32)
    out = []
    for s in shapes:
        h, w = s["size"]
        planes = []
        for c, (bw, bh) in s["comps"].items():
            o, n = s["at"][c]
            plane = samples[o : o + n].reshape(bh, bw, 8, 8).swapaxes(1, 2).reshape(bh * 8, bw * 8)
            fy, fx = -(-h // plane.shape[0]), -(-w // plane.shape[1])
            planes.append((plane.repeat(fy, 0) if fy > 1 else plane).repeat(fx, 1)[:h, :w] if fx > 1 else plane[:h, :w])
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        rgb = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1)
        out.append(np.clip(np.rint(rgb), 0, 255).astype(np.uint8))
    return out


def features(rgb: np.ndarray) -> str:
    """Size, mean of each channel in thousandths, and eight bins of the green channel."""
    mean = (rgb.reshape(-1, 3).sum(0, dtype=np.int64) * 1000 // (rgb.shape[0] * rgb.shape[1])).tolist()
    bins = np.bincount(rgb[..., 1].ravel() >> 5, minlength=8).tolist()
    return f"{rgb.shape[1]}x{rgb.shape[0]};" + ",".join(map(str, mean)) + ";" + ",".join(map(str, bins))


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % BLOCK or (0 if text else BLOCK))


def _batches(payloads: list[bytes]):
    at = size = 0
    for i, p in enumerate(payloads):
        size += len(p)
        if size >= _CHUNK or i + 1 == len(payloads):
            yield slice(at, i + 1)
            at, size = i + 1, 0


def store(docs: DataFrame, text_col: str = "text", media_col: str = "media") -> DataFrame:
    """docs with `media`, a progressive JPEG of the whole text's UTF-8 bytes, in place of a column of that name. Null is empty; an empty text has one block of zeros."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        p = [padded(t) for t in utf8(texts)]
        return pd.Series([f for b in _batches(p) for f in write(p[b])], dtype=object)

    return docs.withColumn(media_col, run(quoted(text_col)))


def _loaded(media: pd.Series):
    """(file, payload, tensor) of each file as read back, Nones for null; some megabytes of files are read abreast."""
    files = [None if m is None else bytes(m) for m in media]
    for b in _batches([f or b"" for f in files]):
        some = [f for f in files[b] if f is not None]
        coef, shapes = read(some) if some else (None, [])
        found = iter(zip(some, shapes, tensors(coef, shapes), strict=True)) if some else iter(())
        for f in files[b]:
            if f is None:
                yield None, None, None
            else:
                f, s, rgb = next(found)
                yield f, payload(coef, s), rgb


def load(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with `payload` (binary), `height`, `width`, `rgb` (binary: rows of pixels) read from `media`, in place of columns of these names; null media give nulls."""

    @F.pandas_udf("payload binary, height int, width int, rgb binary")
    def run(media: pd.Series) -> pd.DataFrame:
        out = [(None, None, None, None) if f is None else (p, *rgb.shape[:2], rgb.tobytes()) for f, p, rgb in _loaded(media)]
        return pd.DataFrame(out, columns=["payload", "height", "width", "rgb"])

    return with_fields(rows, run(quoted(media_col)), ["payload", "height", "width", "rgb"])


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(rows: DataFrame, media_col: str = "media") -> DataFrame:
    """rows with digests of what is read back from `media`, of its bytes, and features of its tensor, in place of the media and of columns of these names.

    A row for each row; null media give nulls. No shuffle.
    """

    @F.pandas_udf(_DIGEST)
    def run(media: pd.Series) -> pd.DataFrame:
        out = [
            (None,) * 6 if f is None else (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(f), hashlib.sha256(f).hexdigest(), features(rgb))
            for f, p, rgb in _loaded(media)
        ]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _DIGEST.split(", ")])

    return with_fields(rows, run(quoted(media_col)), [c.split()[0] for c in _DIGEST.split(", ")], without=(media_col,))


def op7(spark, sf_dir):
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), a row for each row of documents.

    Each text becomes a media column (store), and what is said of it is read back from that column. Null and empty texts: 64 zeros. Repeated rows stay.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return digests(store(docs).drop("text"))
