import numpy as np

from tidemark.llm.media_columns import ZIGZAG, _Bits, decode_progressive, encode_payload, feature, media_columns, media_digest, padded, read_payload, to_rgb


def test_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 63, 64, 65, 4000, 70_000):
        data = rng.bytes(n)
        picture = decode_progressive(encode_payload(padded(data)))
        assert read_payload(picture) == padded(data) and len(padded(data)) % 64 == 0 and padded(data)
        assert to_rgb(picture).shape == (picture.height, picture.width, 3)
    ff = b"\xff" * 640
    assert read_payload(decode_progressive(encode_payload(ff))) == ff


class _Writer:
    """A plain entropy coder with eight-bit codes for every symbol, for pictures that aren't payloads."""

    def __init__(self):
        self.bits: list[int] = []

    def put(self, value: int, n: int) -> None:
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def number(self, value: int) -> None:
        n = abs(value).bit_length()
        self.put(value if value >= 0 else value + (1 << n) - 1, n)

    def bytes(self) -> bytes:
        return np.packbits(self.bits + [1] * (-len(self.bits) % 8)).tobytes().replace(b"\xff", b"\xff\x00")


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _ac_refine(w: _Writer, blocks: np.ndarray) -> None:
    """Refinement from bit 1 to bit 0, one end-of-block for each block."""
    for block in blocks:
        new = [k for k in range(1, 64) if abs(block[k]) == 1]
        k = 1
        for at in [*new, None]:
            if at is None and k == 64:
                break
            run, pending = 0, []
            last = at if at is not None else 64
            while k < last:
                if abs(block[k]) > 1:
                    pending.append(abs(int(block[k])) & 1)
                else:
                    run += 1
                    if run == 16 and at is not None:  # fifteen zeros and one more
                        w.put(0xF0, 8)
                        for b in pending:
                            w.put(b, 1)
                        run, pending = 0, []
                k += 1
            w.put(0x00 if at is None else run << 4 | 1, 8)
            if at is not None:
                w.put(int(block[at] > 0), 1)
                k = at + 1
            for b in pending:
                w.put(b, 1)


def grey_picture(blocks: np.ndarray, rows: int, cols: int) -> bytes:
    """blocks: zigzag coefficients; scans with runs, ends of block over several blocks, and refinements."""
    symbols = bytes([*range(12), *[r << 4 | s for r in range(16) for s in range(1, 11)], 0x00, 0x10, 0x20, 0x30, 0x40, 0xF0])
    symbols = bytes(sorted(set(symbols)))
    codes = {s: i for i, s in enumerate(symbols)}
    table = bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols
    shifted = np.where(blocks < 0, -(-blocks >> 1), blocks >> 1)

    class W(_Writer):
        def put(self, value, n):
            super().put(codes[value] if n == 8 else value, n)

    dc, last = W(), 0
    for value in (blocks[:, 0] >> 1).tolist():
        dc.put(abs(value - last).bit_length(), 8)
        dc.number(value - last)
        last = value
    ac, run = W(), 0

    def flush():
        nonlocal run
        while run:
            n = run.bit_length() - 1
            ac.put(n << 4, 8)
            ac.put(run - (1 << n), n) if n else None
            run = 0

    for block in shifted:
        where = np.flatnonzero(block[1:]) + 1
        if len(where):
            flush()
        k = 1
        for at in where:
            zeros = at - k
            while zeros > 15:
                ac.put(0xF0, 8)
                zeros -= 16
            ac.put(int(zeros << 4 | int(abs(block[at])).bit_length()), 8)
            ac.number(int(block[at]))
            k = at + 1
        if k < 64:
            run += 1
    flush()
    dc2, ac2 = W(), W()
    for value in blocks[:, 0].tolist():
        dc2.bits.append(value & 1)
    _ac_refine(ac2, blocks)
    scan = lambda w, *p: _segment(0xDA, bytes([1, 1, 0x00, *p])) + w.bytes()
    return b"".join([
        b"\xff\xd8", _segment(0xDB, bytes([0]) + bytes([3] * 64)), _segment(0xC2, bytes([8]) + (rows * 8 - 3).to_bytes(2, "big") + (cols * 8 - 5).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])),
        _segment(0xC4, bytes([0x00]) + table + bytes([0x10]) + table), scan(dc, 0, 0, 0x01), scan(ac, 1, 63, 0x01), scan(dc2, 0, 0, 0x10), scan(ac2, 1, 63, 0x10), b"\xff\xd9",
    ])


def test_general_scans():
    rng = np.random.default_rng(4)
    rows, cols = 3, 4
    blocks = np.where(rng.random((rows * cols, 64)) < 0.2, rng.integers(-40, 41, (rows * cols, 64)), 0)
    blocks[5, 1:] = blocks[6, 1:] = 0
    blocks[7, 1:] = 0
    blocks[7, 63] = 1
    picture = decode_progressive(grey_picture(blocks, rows, cols))
    assert (picture.components[0].coefficients.reshape(-1, 64) == blocks).all()
    rgb = to_rgb(picture)
    assert rgb.shape == (rows * 8 - 3, cols * 8 - 5, 3)
    x = np.arange(8)
    c = np.where(x == 0, np.sqrt(1 / 8), 0.5)[:, None] * np.cos((2 * x[None] + 1) * x[:, None] * np.pi / 16)
    square = np.zeros((8, 8))
    square[ZIGZAG[:, 0], ZIGZAG[:, 1]] = blocks[0] * 3
    assert np.abs(np.clip(c.T @ square @ c + 128, 0, 255) - rgb[:8, :8, 0].astype(float)).max() <= 1


def test_bits_end_in_ones():
    b = _Bits(b"\x80")
    assert b.take(1) == 1 and b.take(7) == 0


def test_columns(spark):
    docs = spark.createDataFrame([(1, "héllo", "x"), (2, None, "y"), (3, "", None), (4, "héllo", "z"), (None, "a" * 5000, "w")], "doc_id long, text string, media string")
    rows = {(r["doc_id"], r["n_bytes"]): r for r in media_digest(docs).collect()}
    assert rows[1, 6]["payload_bytes"] == 64 and rows[2, 0]["payload_sha256"] == rows[3, 0]["payload_sha256"] and len(rows) == 5
    assert [rows[1, 6][c] for c in ("media_sha256", "feature")] == [rows[4, 6][c] for c in ("media_sha256", "feature")]
    full = media_columns(docs.select("doc_id", "text"), ["doc_id"]).where("doc_id = 1").first()
    rgb = np.frombuffer(full["rgb"], np.uint8).reshape(full["height"], full["width"], 3)
    assert feature(rgb) == full["feature"] and bytes(full["payload"]) == padded("héllo".encode())
    assert media_digest(docs.limit(0)).count() == 0
