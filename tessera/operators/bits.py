"""Bit and byte coders for tiles: variable-length integers, bit stores, canonical Huffman."""

from __future__ import annotations

import heapq

import numpy as np

INT_MIN = -(1 << 31)
# -- variable-length integers: 1 to 6 bytes ------------------------------------------
#: A value below 127 in size is its own byte; else a byte 127 or -127 and the excess in groups of 7 bits, high ones first.
_MARK = 127
_STEPS = (127, 255, 16639, 2113791, 270549247)


def m32_lengths(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.int64)
    return np.where(v == INT_MIN, 1, 1 + np.searchsorted(np.array(_STEPS), np.abs(v), "right"))


def m32_encode(v: np.ndarray) -> bytes:
    v = v.astype(np.int64)
    if ((short := np.abs(v) < _MARK) | (v == INT_MIN)).all():  # a byte each
        return np.where(short, v, -128).astype(np.int8).tobytes()
    size, length = np.abs(v), m32_lengths(v)
    ends = np.cumsum(length)
    out = np.zeros(int(ends[-1]) if len(v) else 0, np.uint8)
    start = ends - length
    out[start] = np.where(v == INT_MIN, 128, np.where(length > 1, np.where(v < 0, 256 - _MARK, _MARK), v & 255)).astype(np.uint8)
    excess = size - np.array((0, *_STEPS))[length - 1]
    for k in range(1, 6):  # the k-th byte from the end
        at = np.flatnonzero(length > k)
        group = (excess[at] >> (7 * (k - 1))) & 127
        out[ends[at] - k] = group | (128 if k > 1 else 0)
    return out.tobytes()


def m32_decode(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    marks = np.flatnonzero((b == _MARK) | (b == 256 - _MARK))
    if not len(marks):
        v = b[:n].view(np.int8).astype(np.int32)
        v[v == -128] = INT_MIN
        return v
    plain_end = b < 128
    starts, tails, free = [], [], 0
    for m in marks.tolist():  # a mark within a tail isn't one
        if m >= free:
            e = m + 1
            while not plain_end[e]:
                e += 1
            starts.append(m)
            tails.append(e)
            free = e + 1
    starts, tails = np.array(starts, np.int64), np.array(tails, np.int64)
    head = np.ones(len(b), bool)
    for k in range(1, 6):
        at = starts + k
        head[at[at <= tails]] = False
    at = np.flatnonzero(head)[:n]
    v = b[at].view(np.int8).astype(np.int64)
    v[v == -128] = INT_MIN
    long_ = np.searchsorted(at, starts)
    length = tails - starts + 1
    excess = np.zeros(len(starts), np.int64)
    for k in range(1, 6):
        more = length > k
        excess[more] = (excess[more] << 7) | (b[starts[more] + k] & 127)
    size = excess + np.array((0, *_STEPS))[length - 1]
    keep = long_ < len(at)
    v[long_[keep]] = np.where(b[starts] == _MARK, size, -size)[keep]
    return v.astype(np.int32)


# -- bits, least significant first ---------------------------------------------------


def pack_bits(values: np.ndarray, widths: np.ndarray) -> bytes:
    """The low widths[i] bits of each value, one after another."""
    widths = widths.astype(np.int64)
    if not len(values):
        return b""
    of = np.repeat(np.arange(len(values)), widths)
    place = np.arange(len(of)) - np.repeat(np.cumsum(widths) - widths, widths)
    bits = (values.astype(np.uint64)[of] >> place.astype(np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


class BitReader:
    def __init__(self, data: bytes):
        self.value, self.at = int.from_bytes(data, "little"), 0

    def read(self, width: int) -> int:
        v = (self.value >> self.at) & ((1 << width) - 1)
        self.at += width
        return v


# -- canonical Huffman ---------------------------------------------------------------
#: Symbols: bytes -128..127 as 0..255, a 16-bit and a 32-bit escape, null, and end.
SHORT, LONG, NULL, END, SYMBOLS, LIMIT = 256, 257, 258, 259, 260, 15


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, by package-merge."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    leaves = sorted((int(counts[s]), (int(s),)) for s in used)
    level = leaves
    for _ in range(limit - 1):
        packages = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)]
        level = list(heapq.merge(leaves, packages, key=lambda x: x[0]))
    for _, symbols in level[: 2 * len(used) - 2]:
        np.add.at(lengths, list(symbols), 1)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, symbol), bit-reversed for a store that fills low bits first."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for n, s in sorted((int(n), s) for s, n in enumerate(lengths) if n):
        code <<= n - last
        codes[s] = int(f"{code:0{n}b}"[::-1], 2)
        code, last = code + 1, n
    return codes


def _runs(lengths: np.ndarray) -> list[tuple[int, int]]:
    """(length, run) pairs, runs of 256 at most."""
    out: list[tuple[int, int]] = []
    for n in lengths.tolist():
        if out and out[-1][0] == n and out[-1][1] < 256:
            out[-1] = (n, out[-1][1] + 1)
        else:
            out.append((n, 1))
    return out


def _symbols(v: np.ndarray) -> np.ndarray:
    """The symbol of each 64-bit value, the end's not among them."""
    null, small, middle = v == INT_MIN, np.abs(v + 0.5) < 128, np.abs(v + 0.5) < 32768
    return np.where(null, NULL, np.where(small, v + 128, np.where(middle, SHORT, LONG)))


def huffman_least(v: np.ndarray, enough: int = 0) -> int:
    """Bytes that huffman_encode(v) has at least: those of the symbols' entropy, a bit a symbol, and of the runs of used and unused ones.

    With `enough` a bit a symbol will do, if it takes that many bytes.
    """
    if 0 < enough <= (plain := 4 + (len(v) + 8) // 8):
        return plain
    counts = np.bincount(_symbols(v.astype(np.int64)), minlength=SYMBOLS)
    counts[END] += 1
    used = counts[counts > 0]
    total = int(used.sum())
    entropy = total * np.log2(total) - float((used * np.log2(used)).sum())
    body = max(total, int(np.ceil(entropy * (1 - 1e-9) - 1e-6))) + 16 * int(counts[SHORT]) + 32 * int(counts[LONG])
    runs = 1 + int(np.count_nonzero(np.diff(counts > 0)))
    return 2 + -(-12 * runs // 8) + -(-body // 8)


def huffman_encode(v: np.ndarray) -> bytes:
    v = v.astype(np.int64)
    symbol = _symbols(v)
    extra_width = np.where(symbol == SHORT, 16, np.where(symbol == LONG, 32, 0))
    extra = np.where(symbol == SHORT, v & 0xFFFF, np.where(symbol == LONG, v & 0xFFFFFFFF, 0))
    symbol = np.r_[symbol, END]
    lengths = code_lengths(np.bincount(symbol, minlength=SYMBOLS))
    codes = canonical_codes(lengths)
    runs = _runs(lengths)
    head = pack_bits(np.array([x for n, k in runs for x in (n, k - 1)]), np.tile([4, 8], len(runs)))
    values = codes[symbol] | (np.r_[extra, 0] << lengths[symbol])
    body = pack_bits(values, lengths[symbol] + np.r_[extra_width, 0])
    return len(head).to_bytes(2, "little") + head + body


def huffman_decode(data: bytes) -> np.ndarray:
    head = BitReader(data[2 : (at := 2 + int.from_bytes(data[:2], "little"))])
    lengths: list[int] = []
    while len(lengths) < SYMBOLS:
        n = head.read(4)
        lengths += [n] * (head.read(8) + 1)
    lengths_ = np.array(lengths)
    codes = canonical_codes(lengths_)
    table = [0] * (1 << LIMIT)
    for s in np.flatnonzero(lengths_).tolist():
        n = lengths[s]
        for i in range(int(codes[s]), 1 << LIMIT, 1 << n):
            table[i] = s
    out, pos = [], 0
    raw = np.frombuffer(data[at:] + bytes(8), np.uint8)
    windows = raw[:-7].astype(np.uint64)
    for k in range(1, 8):
        windows = windows | (raw[k : len(raw) - 7 + k].astype(np.uint64) << np.uint64(8 * k))
    windows = windows.tolist()
    mask = (1 << LIMIT) - 1
    while True:
        w = windows[pos >> 3] >> (pos & 7)
        s = table[w & mask]
        n = lengths[s]
        pos += n
        if s < 256:
            out.append(s - 128)
        elif s == END:
            return np.array(out, np.int64).astype(np.int32)
        elif s == NULL:
            out.append(INT_MIN)
        elif s == SHORT:
            e = (w >> n) & 0xFFFF
            out.append(e - 65536 if e >= 32768 else e)
            pos += 16
        else:
            e = (w >> n) & 0xFFFFFFFF
            out.append(e - (1 << 32) if e >= 1 << 31 else e)
            pos += 32


# -- checksums -----------------------------------------------------------------------


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0x82F63B78), t >> np.uint32(1))
    return t


_CRC = _crc_table()
_CRC_LIST = _CRC.tolist()


def crc32c(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of bytes; rows are done side by side, a byte at a time."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for j in range(rows.shape[1]):
        crc = _CRC[(crc ^ rows[:, j]) & np.uint32(255)] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


def crc32c_bytes(data: bytes) -> int:
    c, table = 0xFFFFFFFF, _CRC_LIST
    for b in data:
        c = table[(c ^ b) & 255] ^ (c >> 8)
    return c ^ 0xFFFFFFFF


def crc32c_all(data: list[bytes]) -> list[int]:
    """CRC-32C of each; many are done side by side, longest first, each until its end."""
    if len(data) < 16:
        return [crc32c_bytes(d) for d in data]
    size = np.array([len(d) for d in data])
    order = np.argsort(-size, kind="stable")
    starts = np.r_[0, np.cumsum(size)[:-1]][order]
    flat = np.frombuffer(b"".join(data) + b"\0", np.uint8)
    # How many are longer than j.
    longer = len(size) - np.searchsorted(np.sort(size), np.arange(size.max()), "right") if size.max() else []
    crc = np.full(len(data), 0xFFFFFFFF, np.uint32)
    for j, n in enumerate(longer):
        part = crc[:n]
        crc[:n] = _CRC[(part ^ flat[starts[:n] + j]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(data), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out.tolist()
