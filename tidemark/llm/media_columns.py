"""Media columns: texts stored losslessly in progressive JPEGs and read back from their coefficients.

The format's unit is the block of 64 quantised coefficients, so 64 payload bytes are one block: byte b is coefficient
256 + b in zigzag order, with a quantisation table of ones. Blocks fill a colour image with halved chroma: Y first, then
Cb, then Cr; a comment segment says how many blocks count. The scan script is progressive in both senses: DC and AC
bands first without their lowest bits (spectral selection), then refinements bit by bit (successive approximation). All
AC coefficients have 7 bits in their first scan, which with a code of one bit is a byte each.

decode_progressive() reads any Huffman-coded progressive JPEG of 8-bit samples: scans are accumulated into coefficient
arrays. Where a scan's table has one symbol only, every code length is known beforehand and the scan is read by numpy at
once; otherwise symbol by symbol. to_rgb() applies the inverse transform as one exact integer matrix product in numpy, upsamples
chroma and converts to RGB.

A null text counts as empty; an empty text is one block of zeros. Equal texts give equal media and features.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import map_texts, utf8

BLOCK = 64
BASE = 256

#: Coefficient k of a scan is row, column ZIGZAG[k]: along diagonals, odd ones downwards.
ZIGZAG = np.array(sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])))
_SHIFT = 13


def _basis() -> np.ndarray:
    """Row k: the 64 samples that zigzag coefficient k adds, times 2^13 and rounded, so that products stay exact in doubles."""
    x = np.arange(8)
    wave = np.cos((2 * x[None, :] + 1) * x[:, None] * np.pi / 16) / 2
    wave[0] /= np.sqrt(2)
    return np.rint(np.einsum("kx,ky->kxy", wave[ZIGZAG[:, 0]], wave[ZIGZAG[:, 1]]).reshape(64, 64) * (1 << _SHIFT))


_INVERSE = _basis()

# ---- writing -----------------------------------------------------------------------------------------------------


def padded(data: bytes) -> bytes:
    return data + bytes(-len(data) % BLOCK or (0 if data else BLOCK))


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _stuffed(bits: np.ndarray) -> bytes:
    """Bits to bytes, the last filled up with ones; a zero byte follows each 0xFF."""
    data = np.packbits(bits)
    if spare := -bits.size % 8:
        data[-1] |= (1 << spare) - 1
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def _dc_bits(values: np.ndarray) -> bytes:
    """Steps between neighbours: a category in 4 bits, then as many bits."""
    made, held, n, last = [], 0, 0, 0
    for value in values.tolist():
        step, last = value - last, value
        size = abs(step).bit_length()
        held = held << (4 + size) | size << size | (step if step >= 0 else step + (1 << size) - 1)
        n += 4 + size
        if n > 4096:  # a long number would be slow to shift
            made.append((held >> (n & 7)).to_bytes(n >> 3, "big"))
            n &= 7
            held &= (1 << n) - 1
    spare = -n % 8
    made.append((held << spare | (1 << spare) - 1).to_bytes((n + spare) >> 3, "big"))
    return b"".join(made).replace(b"\xff", b"\xff\x00")


#: Huffman tables, as counts of codes by length and symbols: DC categories 0 to 11 in 4 bits each; one AC symbol, a coefficient of 7 bits with no zeros before it; one refinement symbol, end of block.
_DC_TABLE = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
_AC_TABLE = bytes([1] + [0] * 15) + bytes([0x07])
_REFINE_TABLE = bytes([1] + [0] * 15) + bytes([0x00])


def _scan(component: int, table: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return bytes([0xFF, 0xDA, 0, 8, 1, component, table, first, last, high << 4 | low]) + data


def encode_payload(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload, whose length is a positive multiple of 64."""
    blocks = np.frombuffer(payload, np.uint8).reshape(-1, BLOCK)
    mcus = -(-len(blocks) // 6)
    across = int(np.ceil(np.sqrt(mcus)))
    down = -(-mcus // across)
    if max(across, down) * 16 > 65535:
        raise ValueError("payload too long for one image")
    every = np.zeros((6 * across * down, BLOCK), np.uint8)
    every[: len(blocks)] = blocks
    y = every[: 4 * across * down]
    parts = [y, *np.split(every[len(y) :], 2)]
    out = [
        b"\xff\xd8", _segment(0xFE, b"blocks=%d" % len(blocks)), _segment(0xDB, bytes([0]) + bytes([1]) * 64),
        _segment(0xC2, bytes([8]) + (down * 16).to_bytes(2, "big") + (across * 16).to_bytes(2, "big") + bytes([3, 1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + _DC_TABLE + bytes([0x10]) + _AC_TABLE + bytes([0x11]) + _REFINE_TABLE),
    ]
    for number, part in enumerate(parts, 1):
        out.append(_scan(number, 0x00, 0, 0, 0, 1, _dc_bits(((part[:, 0].astype(np.int64) + BASE) >> 1))))
        first = (part >> 2) | 0x40
        out += [_scan(number, 0x00, a, b, 0, 2, first[:, a : b + 1].tobytes()) for a, b in (((1, 5), (6, 63)) if number == 1 else ((1, 63),))]
    for bit in (1, 0):
        for number, part in enumerate(parts, 1):
            if bit == 0:
                out.append(_scan(number, 0x00, 0, 0, 1, 0, _stuffed(part[:, 0] & 1)))
            fix = (part >> bit) & 1
            fix[:, 0] = 0
            out.append(_scan(number, 0x01, 1, 63, bit + 1, bit, _stuffed(fix)))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading -----------------------------------------------------------------------------------------------------


@dataclass
class Component:
    number: int
    across: int  # sampling factors
    down: int
    quantiser: int
    coefficients: np.ndarray  # block rows, block columns, 64 in zigzag order; whole MCUs
    rows: int = 0  # blocks that scans of this component alone have
    cols: int = 0


@dataclass
class Picture:
    width: int = 0
    height: int = 0
    comment: bytes = b""
    components: list[Component] = field(default_factory=list)
    quantisers: dict[int, np.ndarray] = field(default_factory=dict)


@dataclass
class _Table:
    lookup: list[int]  # by 16 bits: length << 8 | symbol, 0 for no code
    only: tuple[int, int] | None  # symbol and length, if there is one code


def _table(counts: bytes, symbols: bytes) -> _Table:
    lookup, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            begin = code << (16 - length)
            lookup[begin : begin + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
            code += 1
        at += n
        code <<= 1
    return _Table(lookup, (symbols[0], next(i for i, n in enumerate(counts, 1) if n)) if len(symbols) == 1 else None)


class _Bits:
    """Bits of one restart interval."""

    def __init__(self, data: bytes):
        self.data = data.replace(b"\xff\x00", b"\xff")
        self.at = 0
        self._bits: np.ndarray | None = None
        self._windows: list[int] | None = None

    @property
    def bits(self) -> np.ndarray:
        if self._bits is None:
            self._bits = np.unpackbits(np.frombuffer(self.data, np.uint8))
        return self._bits

    @property
    def windows(self) -> list[int]:
        """The 16 bits from each bit on, as a number; ones follow the end."""
        if self._windows is None:
            data = np.frombuffer(self.data + b"\xff\xff\xff\xff", np.uint8).astype(np.uint32)
            words = (data[:-3] << 16 | data[1:-2] << 8 | data[2:-1])[:, None]
            self._windows = ((words >> np.arange(8, 0, -1, dtype=np.uint32)) & 0xFFFF).reshape(-1).tolist()
        return self._windows

    def _window(self) -> int:
        return self.windows[self.at]

    def symbol(self, table: _Table) -> int:
        found = table.lookup[self._window()]
        if not found:
            raise ValueError("no such Huffman code")
        self.at += found >> 8
        return found & 0xFF

    def take(self, n: int) -> int:
        if n == 0:
            return 0
        value = self._window() >> (16 - n)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if n == 0 or value >> (n - 1) else value - (1 << n) + 1


def _dc_first(bits: _Bits, table: _Table, blocks: np.ndarray, low: int) -> None:
    last, at, out, windows, lookup = 0, bits.at, [], bits.windows, table.lookup
    for _ in range(len(blocks)):
        found = lookup[windows[at]]
        at += found >> 8
        if size := found & 0xFF:
            value = windows[at] >> (16 - size)
            last += value if value >> (size - 1) else value - (1 << size) + 1
            at += size
        out.append(last)
    bits.at = at
    blocks[:, 0] = np.array(out, np.int32) << low


def _dc_refine(bits: _Bits, blocks: np.ndarray, low: int) -> None:
    blocks[:, 0] |= bits.bits[bits.at : bits.at + len(blocks)].astype(np.int32) << low
    bits.at += len(blocks)


def _ac_first(bits: _Bits, table: _Table, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    width = last - first + 1
    if table.only and table.only[0] >> 4 == 0 and 0 < table.only[0] <= 10:
        size, length = table.only
        if size + length == 8:
            value = np.frombuffer(bits.data, np.uint8, len(blocks) * width).astype(np.int32) & ((1 << size) - 1)
        else:
            value = bits.bits[: len(blocks) * width * (size + length)].reshape(-1, size + length)[:, length:] @ (1 << np.arange(size - 1, -1, -1, dtype=np.int32))
        if value.min(initial=1 << size) < 1 << (size - 1):
            value = np.where(value >> (size - 1), value, value - (1 << size) + 1)
        blocks[:, first : last + 1] = (value << low).reshape(-1, width)
        return
    run = 0
    for block in blocks:
        if run:
            run -= 1
            continue
        k = first
        while k <= last:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            if size:
                k += zeros
                block[k] = bits.signed(size) * (1 << low)
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros) - 1
                break
            else:
                k += 15
            k += 1


def _ac_refine(bits: _Bits, table: _Table, blocks: np.ndarray, first: int, last: int, low: int) -> None:
    one = 1 << low
    band = blocks[:, first : last + 1]
    if table.only and table.only[0] == 0 and ((positive := band.min(initial=1) > 0) or (band != 0).all()):
        width, length = band.shape[1], table.only[1]
        fix = bits.bits[: len(blocks) * (width + length)].reshape(len(blocks), -1)[:, length:]
        band += fix.astype(np.int32) << low if positive else np.where(band > 0, one, -one) * fix
        return

    def correct(block: np.ndarray, k: int) -> None:
        if bits.take(1) and not abs(int(block[k])) & one:
            block[k] += one if block[k] > 0 else -one

    run = 0
    for block in blocks:
        k = first
        while k <= last and not run:
            symbol = bits.symbol(table)
            zeros, size = symbol >> 4, symbol & 15
            new = 0
            if size:
                new = one if bits.take(1) else -one
            elif zeros < 15:
                run = (1 << zeros) + bits.take(zeros)
                break
            while k <= last:
                if block[k]:
                    correct(block, k)
                elif zeros == 0:
                    block[k] = new
                    k += 1
                    break
                else:
                    zeros -= 1
                k += 1
        if run:
            for k in range(k, last + 1):
                if block[k]:
                    correct(block, k)
            run -= 1


def _frame(picture: Picture, body: bytes) -> None:
    if body[0] != 8:
        raise ValueError("samples must have 8 bits")
    picture.height, picture.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
    given = [(body[i], body[i + 1] >> 4, body[i + 1] & 15, body[i + 2]) for i in range(6, 6 + 3 * body[5], 3)]
    most_across, most_down = max(g[1] for g in given), max(g[2] for g in given)
    mcus_across, mcus_down = -(-picture.width // (8 * most_across)), -(-picture.height // (8 * most_down))
    for number, across, down, quantiser in given:
        own = Component(number, across, down, quantiser, np.zeros((mcus_down * down, mcus_across * across, 64), np.int32))
        own.rows, own.cols = -(-(-(-picture.height * down // most_down)) // 8), -(-(-(-picture.width * across // most_across)) // 8)
        picture.components.append(own)


def _read_scan(picture: Picture, body: bytes, tables: dict[int, _Table], pieces: list[bytes], restart: int) -> None:
    n = body[0]
    chosen = [(next(c for c in picture.components if c.number == body[1 + 2 * i]), body[2 + 2 * i]) for i in range(n)]
    first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
    if n == 1:
        component, which = chosen[0]
        whole = component.coefficients[: component.rows, : component.cols]
        blocks = whole.reshape(-1, 64)  # a view unless the picture's edge cuts MCUs
        step = restart or len(blocks)
        for i, piece in enumerate(pieces):
            part, bits = blocks[i * step : (i + 1) * step], _Bits(piece)
            if first == 0:
                _dc_refine(bits, part, low) if high else _dc_first(bits, tables[which >> 4], part, low)
            else:
                (_ac_refine if high else _ac_first)(bits, tables[0x10 | which & 15], part, first, last, low)
        if not np.shares_memory(blocks, whole):
            whole[:] = blocks.reshape(whole.shape)
        return
    mcus_down, mcus_across = chosen[0][0].coefficients.shape[0] // chosen[0][0].down, chosen[0][0].coefficients.shape[1] // chosen[0][0].across
    step, mcu = restart or mcus_down * mcus_across, 0
    for piece in pieces:
        bits, last_dc = _Bits(piece), {}
        for mcu in range(mcu, min(mcu + step, mcus_down * mcus_across)):
            for component, which in chosen:
                for r in range(component.down):
                    for c in range(component.across):
                        block = component.coefficients[mcu // mcus_across * component.down + r, mcu % mcus_across * component.across + c]
                        if high:
                            block[0] |= bits.take(1) << low
                        else:
                            last_dc[component.number] = last_dc.get(component.number, 0) + bits.signed(bits.symbol(tables[which >> 4]))
                            block[0] = last_dc[component.number] << low
        mcu += 1


def decode_progressive(data: bytes) -> Picture:
    """All scans of a progressive JPEG, accumulated into each component's coefficients."""
    codes = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((codes[:-1] == 0xFF) & (codes[1:] != 0) & (codes[1:] != 0xFF))
    picture, tables, restart, at = Picture(), {}, 0, 2
    while data[at + 1] != 0xD9:
        marker, length = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xFE:
            picture.comment = body
        elif marker == 0xDB:
            while body:
                wide = 1 + (body[0] >> 4)
                picture.quantisers[body[0] & 15] = np.array([int.from_bytes(body[1 + i * wide : 1 + (i + 1) * wide], "big") for i in range(64)])
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _shared_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _frame(picture, body)
        elif marker in (0xC0, 0xC1, *range(0xC3, 0xC4), *range(0xC5, 0xD0)):
            raise ValueError("not a Huffman-coded progressive JPEG")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            pieces, begin = [], at
            for end in ends[np.searchsorted(ends, at) :].tolist():
                pieces.append(data[begin:end])
                begin = end + 2
                if not 0xD0 <= codes[end + 1] <= 0xD7:
                    at = end
                    break
            _read_scan(picture, body, tables, pieces, restart)
    return picture


_TABLES: dict[tuple[bytes, bytes], _Table] = {}


def _shared_table(counts: bytes, symbols: bytes) -> _Table:
    if (counts, symbols) not in _TABLES:
        if len(_TABLES) > 64:
            _TABLES.clear()
        _TABLES[counts, symbols] = _table(counts, symbols)
    return _TABLES[counts, symbols]


def read_payload(picture: Picture) -> bytes:
    """What encode_payload() was given."""
    blocks = np.concatenate([c.coefficients.reshape(-1, 64) for c in picture.components])
    return (blocks[: int(picture.comment.split(b"=")[1])] - BASE).astype(np.uint8).tobytes()


def to_rgb(picture: Picture) -> np.ndarray:
    """Height, width, 3: samples of the inverse transform at full resolution. Grey pictures repeat their only component."""
    planes = []
    most_across, most_down = max(c.across for c in picture.components), max(c.down for c in picture.components)
    for c in picture.components:
        rows, cols, _ = c.coefficients.shape
        exact = (c.coefficients.reshape(-1, 64) * picture.quantisers[c.quantiser]).astype(float) @ _INVERSE
        samples = np.clip(np.floor((exact + (1 << (_SHIFT - 1))) / (1 << _SHIFT)) + 128, 0, 255).astype(np.int32)
        plane = samples.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(rows * 8, cols * 8)
        plane = plane.repeat(most_down // c.down, 0).repeat(most_across // c.across, 1)
        planes.append(plane[: picture.height, : picture.width])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, 2).astype(np.uint8)
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    half = 1 << 15
    red, blue = y + ((91881 * cr + half) >> 16), y + ((116130 * cb + half) >> 16)
    green = y - ((22554 * cb + 46802 * cr + half) >> 16)
    return np.clip(np.stack([red, green, blue], 2), 0, 255).astype(np.uint8)


def feature(rgb: np.ndarray) -> str:
    """Size, channel means and mean absolute steps across and down, in thousandths, from integer sums only."""
    height, width, _ = rgb.shape
    wide = rgb.astype(np.int16)
    means = [int(s) * 1000 // (height * width) for s in rgb.sum((0, 1), dtype=np.int64)]
    steps = [int(np.abs(np.diff(wide, axis=a)).sum(dtype=np.int64)) * 1000 // (3 * height * width) for a in (1, 0)]
    return f"{width}x{height}:" + ",".join(map(str, means + steps))


def media_columns(docs: DataFrame, keep: list[str], tensors: bool = True) -> DataFrame:
    """keep, n_bytes, media (the JPEG), payload (read back from the stored bytes), width, height, feature, and with tensors rgb (height * width * 3 bytes), for every row."""

    def compute(part: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("n_bytes", "media", "payload", "width", "height", "feature", "rgb")}
        for data in utf8(part):
            media = encode_payload(padded(data))
            picture = decode_progressive(media)
            rgb = to_rgb(picture)
            for k, v in (("n_bytes", len(data)), ("media", media), ("payload", read_payload(picture)), ("width", picture.width), ("height", picture.height), ("feature", feature(rgb)), ("rgb", rgb.tobytes() if tensors else None)):
                out[k].append(v)
        return {c: part.column(c) for c in keep} | out

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_texts(docs, keep, compute, f"{schema}, n_bytes bigint, media binary, payload binary, width int, height int, feature string" + ", rgb binary" * tensors)


def media_digest(docs: DataFrame) -> DataFrame:
    """One row a document: lengths and hashes of what was stored and read back, and the picture's feature."""
    made = media_columns(docs.select("doc_id", "text"), ["doc_id"], tensors=False)
    return made.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
