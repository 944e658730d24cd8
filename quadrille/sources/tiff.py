"""TIFF files with georeferencing: headers, strips and tiles, LZW."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from ..grid import GridSpec

_KINDS = {1: "B", 2: "c", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}


def lzw_decode(data: bytes) -> bytes:
    """TIFF's LZW: codes from 9 bits, most significant bit first, widths that change one code early."""
    out, table, width, acc, bits, last = [], [], 9, 0, 0, None
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in data:
        acc = (acc << 8 | byte) & 0xFFFFFFFF
        bits += 8
        while bits >= width:
            code = acc >> (bits - width) & ((1 << width) - 1)
            bits -= width
            if code == 257:
                return b"".join(out)
            if code == 256:
                table, width, last = base.copy(), 9, None
                continue
            if not table:
                table = base.copy()
            if last is None:
                entry = table[code]
            else:
                entry = table[code] if code < len(table) else last + last[:1]
                table.append(last + entry[:1])
            out.append(entry)
            last = entry
            width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits, width = bytearray(), 0, 0, 9
    table: dict[bytes, int] = {}

    def put(code: int) -> None:
        nonlocal acc, bits
        acc = acc << width | code
        bits += width
        while bits >= 8:
            out.append(acc >> (bits - 8) & 255)
            bits -= 8
        acc &= (1 << bits) - 1

    def fresh() -> None:
        nonlocal table, width
        put(256)
        table, width = {bytes([i]): i for i in range(256)}, 9

    fresh()
    word = b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = len(table) + 2
        n = len(table) + 2
        if n >= 4095:
            fresh()
        else:
            width = 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(table[word])
        n = len(table) + 3
        width = max(width, 9 if n < 512 else 10 if n < 1024 else 11 if n < 2048 else 12)
    put(257)
    if bits:
        out.append(acc << (8 - bits) & 255)
    return bytes(out)


@dataclass(frozen=True)
class Header:
    grid: GridSpec
    bands: int
    dtype: str
    compression: int
    predictor: int
    planar: int
    nodata: float | None
    block: tuple[int, int]  # rows, columns
    tiled: bool
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def blocks_across(self) -> int:
        return -(-self.grid.width // self.block[1]) if self.tiled else 1

    @property
    def blocks_a_plane(self) -> int:
        return self.blocks_across * -(-self.grid.height // self.block[0])


def read_header(path: str) -> Header:
    with open(path, "rb") as f:
        magic = f.read(8)
        order = {b"II": "<", b"MM": ">"}.get(magic[:2])
        if order is None or struct.unpack(order + "H", magic[2:4])[0] != 42:
            raise ValueError(f"{path} is not a TIFF file")
        f.seek(struct.unpack(order + "I", magic[4:8])[0])
        (n,) = struct.unpack(order + "H", f.read(2))
        raw, tags = f.read(12 * n), {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", raw, 12 * k)
            if kind not in _KINDS:
                continue
            size = struct.calcsize("=" + _KINDS[kind]) * count
            if size <= 4:
                value = raw[12 * k + 8 : 12 * k + 8 + size]
            else:
                f.seek(struct.unpack_from(order + "I", raw, 12 * k + 8)[0])
                value = f.read(size)
            tags[tag] = value if kind == 2 else struct.unpack(f"{order}{count * len(_KINDS[kind])}{_KINDS[kind][0]}", value)
    one = lambda t, d: tags[t][0] if t in tags else d
    width, height, bits, form = one(256, 0), one(257, 0), one(258, 1), one(339, 1)
    dtype = f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[form] }{bits // 8}".replace(" ", "")
    scale, tie = tags.get(33550, (1.0, 1.0, 0.0)), tags.get(33922, (0.0,) * 6)
    crs = ""
    if keys := tags.get(34735):
        for k in range(4, len(keys), 4):
            if keys[k] in (2048, 3072) and keys[k + 1] == 0:
                crs = f"EPSG:{keys[k + 3]}"
    grid = GridSpec(width, height, scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1], crs)
    tiled = 322 in tags
    nodata = tags.get(42113)
    return Header(
        grid, one(277, 1), dtype, one(259, 1), one(317, 1), one(284, 1), float(nodata.rstrip(b"\0 ").decode()) if nodata else None,
        (one(323, 0), one(322, 0)) if tiled else (min(one(278, height), height), width), tiled, tags[324 if tiled else 273], tags[325 if tiled else 279],
    )


def read_block(path: str, h: Header, index: int, band: int) -> tuple[int, int, np.ndarray]:
    """First row, first column and values of a block (strip or tile) of a band, numbered from 0."""
    at = index + (band * h.blocks_a_plane if h.planar == 2 else 0)
    with open(path, "rb") as f:
        f.seek(h.offsets[at])
        data = f.read(h.counts[at])
    if h.compression == 5:
        data = lzw_decode(data)
    elif h.compression in (8, 32946):
        data = zlib.decompress(data)
    elif h.compression != 1:
        raise ValueError(f"TIFF compression {h.compression} is not supported")
    r0, c0 = index // h.blocks_across * h.block[0], index % h.blocks_across * h.block[1]
    rows = h.block[0] if h.tiled else min(h.block[0], h.grid.height - r0)
    bands = 1 if h.planar == 2 else h.bands
    a = np.frombuffer(data, h.dtype, rows * h.block[1] * bands).reshape(rows, h.block[1], bands)
    if h.predictor == 2:
        a = np.cumsum(a, axis=1, dtype=a.dtype)
    elif h.predictor != 1:
        raise ValueError(f"TIFF predictor {h.predictor} is not supported")
    a = a[:, :, 0 if h.planar == 2 else band]
    return r0, c0, a[: h.grid.height - r0, : h.grid.width - c0]


def write_strips(path: str, grid: GridSpec, strips: Iterable[np.ndarray], rows: int, dtype: str = "float32", nodata: float | None = None, compress: bool = True) -> None:
    """Write one band from strips of ``rows`` rows, top first; a strip is in memory at a time."""
    kind = np.dtype(dtype).newbyteorder("<")
    offsets, counts = [], []
    with open(path, "wb") as f:
        f.write(b"II*\0\0\0\0\0")
        for s in strips:
            data = np.ascontiguousarray(s, kind).tobytes()
            data = lzw_encode(data) if compress else data
            offsets.append(f.tell())
            counts.append(len(data))
            f.write(data)
        form = {"u": 1, "i": 2, "f": 3}[kind.kind]
        code = int(grid.crs.split(":")[1]) if grid.crs.startswith("EPSG:") else 0
        geographic = code in (4326, 4674)
        keys = (1, 1, 0, 3, 1024, 0, 1, 2 if geographic else 1, 1025, 0, 1, 1, 2048 if geographic else 3072, 0, 1, code)
        tags: list[tuple[int, int, tuple | bytes]] = [
            (256, 4, (grid.width,)), (257, 4, (grid.height,)), (258, 3, (kind.itemsize * 8,)), (259, 3, (5 if compress else 1,)), (262, 3, (1,)), (273, 4, tuple(offsets)), (277, 3, (1,)),
            (278, 4, (rows,)), (279, 4, tuple(counts)), (284, 3, (1,)), (339, 3, (form,)), (33550, 12, (abs(grid.a), abs(grid.e), 0.0)), (33922, 12, (0.0, 0.0, 0.0, grid.c, grid.f, 0.0)),
        ]
        tags += [(34735, 3, keys)] * bool(code) + [(42113, 2, f"{nodata}\0".encode())] * (nodata is not None)
        entries = b""
        for tag, t, value in tags:
            blob = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{_KINDS[t]}", *value)
            if len(blob) > 4:
                f.write(b"\0" * (f.tell() % 2))
                where, blob = f.tell(), (f.write(blob), b"")[1]
                blob = struct.pack("<I", where)
            entries += struct.pack("<HHI", tag, t, len(value)) + blob.ljust(4, b"\0")
        f.write(b"\0" * (f.tell() % 2))
        directory = f.tell()
        f.write(struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")
        f.seek(4)
        f.write(struct.pack("<I", directory))


def strips_of(rows: Iterator[tuple[int, int, float]], grid: GridSpec, height: int, fill: float) -> Iterator[np.ndarray]:
    """Strips from (row, col, value) in order of row; pixels without a row have ``fill``."""
    at = 0
    new = lambda: np.full((min(height, grid.height - at), grid.width), fill, float)
    strip = new()
    for r, c, v in rows:
        while r >= at + height:
            yield strip
            at += height
            strip = new()
        strip[r - at, c] = fill if v is None else v
    while at < grid.height:
        yield strip
        at += height
        if at < grid.height:
            strip = new()
