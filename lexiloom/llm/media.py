"""Media columns: progressive JPEG files written and read in numpy.

A payload of bytes is stored losslessly in the format's own unit, the quantised DCT coefficient:
one byte per coefficient, four luma blocks and one block of each chroma per 16 x 16 pixel unit. AC
bytes use the 256 values of magnitude category 8, so no coefficient is zero and each scan has a
regular form; DC bytes are coded by differences. The scans use
spectral selection (two bands of luma) and successive approximation by one bit.

The reader accumulates any progressive scans (Huffman coding, no restart markers) into coefficient
arrays. Scans of regular form are recognised exactly and read as arrays of bits; others are read
symbol by symbol. Blocks are inverse-transformed by matrix products, chroma is upsampled, and the
result is a full-resolution RGB tensor, made in strips so that memory stays bounded.

Edge cases: null and empty text give a payload of 192 spaces; any length is stored whole (up to the
format's 65535 x 65535 pixels); repeated rows, null ids and extra columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import free_name, utf8

UNIT, PAD, MCU = 192, 32, 384
#: Spectral bands of the AC scans: two for luma, one for each chroma.
BANDS = (((1, 5), (6, 63)), ((1, 63),), ((1, 63),))
#: Strips of this many rows of 16 x 16 units are transformed at once.
STRIP = 32


def _zigzag() -> np.ndarray:
    """Raster index of each coefficient in scan order."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


ZIGZAG = _zigzag()
#: Rows: frequencies; columns: positions.
BASIS = np.array(
    [[(0.5 if u else 0.5**1.5) * np.cos((2 * x + 1) * u * np.pi / 16) for x in range(8)] for u in range(8)], np.float32
)


def padded(raw: bytes) -> bytes:
    """The payload: the text's bytes and spaces up to a positive multiple of 192."""
    return raw + b" " * (-len(raw) % UNIT if raw else UNIT)


# ---- writing


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _flat_table(slot: int, symbols: list[int], length: int) -> bytes:
    """A Huffman table whose codes all have one length."""
    return bytes([slot, *(len(symbols) if n == length else 0 for n in range(1, 17)), *symbols])


def _scan(parts: list[tuple[int, int]], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(parts), *(x for p in parts for x in p), ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data.replace(b"\xff", b"\xff\x00")


def _pack(bits: np.ndarray) -> bytes:
    """Bits to bytes, the last one filled with ones."""
    return np.packbits(np.concatenate([bits, np.ones(-len(bits) % 8, np.uint8)])).tobytes()


def _code_bits(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The low `lengths` bits of each value, in order."""
    width = int(lengths.max(initial=0))
    at = np.arange(width)
    shift = lengths[:, None] - 1 - at
    bits = (values[:, None] >> np.maximum(shift, 0)) & 1
    return bits[shift >= 0].astype(np.uint8)


def encode(payload: bytes) -> bytes:
    """A progressive JPEG whose coefficients are the payload's bytes."""
    units = -(-len(payload) // MCU)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    grid = np.full(across * down * MCU, PAD, np.uint8)
    grid[: len(payload)] = np.frombuffer(payload, np.uint8)
    grid = grid.reshape(down, across, 6, 64)
    luma = grid[:, :, :4].reshape(down, across, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)
    planes = [luma, grid[:, :, 4].reshape(-1, 64), grid[:, :, 5].reshape(-1, 64)]
    factors = [0x22, 0x11, 0x11]
    frame = struct.pack(">BHHB", 8, down * 16, across * 16, 3) + bytes(x for c in range(3) for x in (c + 1, factors[c], 0))
    out = [
        b"\xff\xd8", _segment(0xFE, struct.pack(">Q", len(payload))), _segment(0xDB, bytes([0]) + b"\x01" * 64), _segment(0xC2, frame),
        _segment(0xC4, _flat_table(0x00, list(range(12)), 4) + _flat_table(0x10, [0x07], 1) + _flat_table(0x11, [r << 4 for r in range(15)], 4)),
    ]
    dc = grid[:, :, :, 0].reshape(-1, 6).astype(np.int32) - 128
    high = dc >> 1
    diff = np.empty_like(high)
    diff[:, :4] = np.diff(high[:, :4].ravel(), prepend=0).reshape(-1, 4)
    diff[:, 4:] = np.diff(high[:, 4:], axis=0, prepend=0)
    diff = diff.ravel()
    size = np.ceil(np.log2(np.abs(diff) + 1)).astype(np.int32)
    extra = np.where(diff < 0, diff + (1 << size) - 1, diff)
    everything = [(c + 1, 0x00) for c in range(3)]
    out.append(_scan(everything, 0, 0, 0, 1, _pack(_code_bits((size << size) | extra, 4 + size))))
    for c, plane in enumerate(planes):
        for ss, se in BANDS[c]:  # the code 0 of symbol 0x07 and seven bits: one byte for each coefficient
            out.append(_scan([(c + 1, 0x00)], ss, se, 0, 1, (plane[:, ss : se + 1] >> 1).tobytes()))
    out.append(_scan(everything, 0, 0, 1, 0, _pack((dc & 1).astype(np.uint8).ravel())))
    for c, plane in enumerate(planes):
        for ss, se in BANDS[c]:
            band = plane[:, ss : se + 1]
            low = ((band & 1) ^ (band < 128)).astype(np.uint8)
            bits = []
            for start in range(0, len(low), 32767):
                part = low[start : start + 32767]
                r = len(part).bit_length() - 1
                bits += [_code_bits(np.array([r, len(part) - (1 << r)]), np.array([4, r])), part.ravel()]
            out.append(_scan([(c + 1, 0x01)], ss, se, 1, 0, _pack(np.concatenate(bits))))
    return b"".join([*out, b"\xff\xd9"])


# ---- reading


@functools.lru_cache(maxsize=64)
def _lookup(lengths: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and code length for every 16-bit window; length 0: no code."""
    symbol, length = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
    code, k = 0, 0
    for n in range(1, 17):
        for _ in range(lengths[n - 1]):
            at = code << (16 - n)
            symbol[at : at + (1 << (16 - n))], length[at : at + (1 << (16 - n))] = symbols[k], n
            code, k = code + 1, k + 1
        code <<= 1
    return symbol, length


def _extended(value: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Signed values of categories: the lower half of the codes are negative."""
    return np.where(value < (1 << size >> 1), value - (1 << size) + 1, value)


class Component:
    """One component's factors and coefficients, in scan order, for all blocks of whole units."""

    def __init__(self, h: int, v: int, table: int) -> None:
        self.h, self.v, self.table = h, v, table

    def layout(self, width: int, height: int, hmax: int, vmax: int) -> None:
        self.across, self.down = -(-width // (8 * hmax)) * self.h, -(-height // (8 * vmax)) * self.v
        self.used = (-(-(-(-height * self.v // vmax)) // 8), -(-(-(-width * self.h // hmax)) // 8))
        self.blocks = np.zeros((self.down, self.across, 64), np.int16)


class _Bits:
    """Symbols and bits of one scan, read in sequence."""

    def __init__(self, data: bytes, table) -> None:
        self.bits = np.unpackbits(np.frombuffer(data + b"\xff" * 8, np.uint8))
        self.at, self.table = 0, table

    def take(self, n: int) -> int:
        value = 0
        for b in self.bits[self.at : self.at + n].tolist():
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self) -> int:
        window = self.take(16)
        self.at -= 16
        if not (n := int(self.table[1][window])):
            raise ValueError("no such Huffman code")
        self.at += n
        return int(self.table[0][window])


def _dc_symbols(data: bytes, table, count: int) -> np.ndarray:
    """The first `count` signed values of a DC scan; every bit position is decoded at once, then the chain of symbols followed."""
    raw = np.frombuffer(data + b"\xff" * 8, np.uint8).astype(np.int32)
    wide = raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]
    window = ((wide[:, None] >> (8 - np.arange(8))) & 0xFFFF).ravel()
    size, length = table[0][window], table[1][window]
    ahead = (np.arange(len(window)) + length + size).tolist()
    at, places = 0, []
    for _ in range(count):
        places.append(at)
        at = ahead[at]
    places = np.array(places, np.int64)
    size = size[places]
    value = window[places + length[places]] >> (16 - size)
    return _extended(value, size)


def _ac_first(data: bytes, table, blocks: np.ndarray, ss: int, se: int, al: int) -> None:
    """A first AC scan into blocks (n, 64)."""
    n, width = len(blocks), se - ss + 1
    head = (int.from_bytes((data + b"\xff\xff")[:2]),)[0]
    symbol, length = int(table[0][head]), int(table[1][head])
    if length and 0 < symbol < 16:
        each = length + symbol
        if n * width * each <= len(data) * 8:
            bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width * each).reshape(-1, each)
            if (bits[:, :length] == bits[0, :length]).all():  # then every symbol is this one
                value = bits[:, length:].astype(np.int16) @ (1 << np.arange(symbol)[::-1]).astype(np.int16)
                blocks[:, ss : se + 1] = (_extended(value, np.int16(symbol)) * (1 << al)).reshape(n, width)
                return
    stream, skip = _Bits(data, table), 0
    for block in blocks:
        if skip:
            skip -= 1
            continue
        k = ss
        while k <= se:
            run, size = divmod(stream.symbol(), 16)
            if size:
                k += run
                block[k] = int(_extended(np.int32(stream.take(size)), np.int32(size))) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            else:
                skip = (1 << run) - 1 + stream.take(run)
                break


def _ac_refine(data: bytes, table, blocks: np.ndarray, ss: int, se: int, al: int) -> None:
    """A refining AC scan: correction bits of known coefficients, and coefficients that are new at this bit."""
    stream, at_block, step = _Bits(data, table), 0, 1 << al
    band = blocks[:, ss : se + 1]

    def correct(part: np.ndarray) -> None:
        """One bit for each coefficient known in these blocks' rest, in order."""
        known = np.flatnonzero(part)
        bits = stream.bits[stream.at : stream.at + len(known)]
        stream.at += len(known)
        flat = part.reshape(-1)
        flat[known] += np.sign(flat[known]) * (bits * np.int16(step)).astype(np.int16)
        part[...] = flat.reshape(part.shape)

    while at_block < len(band):
        k, row, width = 0, band[at_block], se - ss + 1
        skip = 0
        while k < width:
            run, size = divmod(stream.symbol(), 16)
            if not size and run < 15:
                skip = (1 << run) + stream.take(run)
                break
            new = (1 if stream.take(1) else -1) * step if size else 0
            while k < width:
                if row[k]:
                    if stream.take(1):
                        row[k] += step if row[k] > 0 else -step
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if new and k < width:
                row[k] = new
            k += 1
        if skip:
            correct(row[k:])
            correct(band[at_block + 1 : at_block + skip])
        at_block += max(1, skip)


def read(media: bytes) -> tuple[int, int, list[Component], dict[int, np.ndarray], bytes]:
    """Width, height, components with all scans accumulated, quantisation tables and the comment."""
    at, tables, quant, comment = 2, {}, {}, b""
    parts: dict[int, Component] = {}
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while media[at + 1] != 0xD9:
        marker, size = media[at + 1], int.from_bytes(media[at + 2 : at + 4])
        body = media[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _lookup(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            for i in range(n):
                c, factor, q = body[6 + 3 * i : 9 + 3 * i]
                parts[c] = Component(factor >> 4, factor & 15, q)
            hmax, vmax = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            for p in parts.values():
                p.layout(width, height, hmax, vmax)
        elif marker in (0xC0, 0xC1, 0xDD):
            raise ValueError("only progressive files without restart markers are read")
        elif marker == 0xDA:
            end = at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1]:
                    break
                end += 2
            data, at = media[at:end].replace(b"\xff\x00", b"\xff"), end
            chosen = [(parts[body[1 + 2 * i]], body[2 + 2 * i]) for i in range(body[0])]
            ss, se, ah, al = body[-3], body[-2], body[-1] >> 4, body[-1] & 15
            if ss:
                (p, slot), = chosen
                whole = p.used == (p.down, p.across)
                rows = p.blocks.reshape(-1, 64) if whole else p.blocks[: p.used[0], : p.used[1]].reshape(-1, 64)
                (_ac_refine if ah else _ac_first)(data, tables[0x10 | slot & 15], rows, ss, se, al)
                if not whole:
                    p.blocks[: p.used[0], : p.used[1]] = rows.reshape(*p.used, 64)
            else:
                _dc_scan(data, [(p, tables.get(slot >> 4)) for p, slot in chosen], ah, al)
    return width, height, list(parts.values()), quant, comment


def _dc_scan(data: bytes, chosen: list, ah: int, al: int) -> None:
    """An interleaved DC scan over whole units, or one component's over its own blocks."""
    alone = len(chosen) == 1
    views, counts = [], []
    for p, _ in chosen:
        if alone:
            views.append(p.blocks[: p.used[0], : p.used[1], 0][None, None])
            counts.append(p.used[0] * p.used[1])
        else:
            views.append(p.blocks[:, :, 0].reshape(p.down // p.v, p.v, p.across // p.h, p.h).transpose(0, 2, 1, 3))
            counts.append(p.v * p.h)
    units = views[0].shape[0] * views[0].shape[1]
    total = units * sum(counts)
    if ah:
        values = np.unpackbits(np.frombuffer(data, np.uint8), count=total).reshape(units, -1).astype(np.int16)
    else:
        values = _dc_symbols(data, chosen[0][1], total).reshape(units, -1)
    at = 0
    for (p, _), view, n in zip(chosen, views, counts):
        own = values[:, at : at + n]
        at += n
        if ah:
            view |= (own << al).reshape(view.shape).astype(np.int16)
        else:
            view[...] = (own.ravel().cumsum() << al).reshape(view.shape)


def strips(width: int, height: int, parts: list[Component], quant: dict[int, np.ndarray]) -> Iterator[np.ndarray]:
    """RGB rows of the picture, some rows of units at a time."""
    hmax, vmax = max(p.h for p in parts), max(p.v for p in parts)
    units = -(-height // (8 * vmax))
    back = np.argsort(ZIGZAG)
    for first in range(0, units, STRIP):
        planes = []
        for p in parts:
            blocks = p.blocks[first * p.v : (first + STRIP) * p.v]
            x = (blocks * quant[p.table])[:, :, back].reshape(-1, 8, 8).astype(np.float32)
            y = BASIS.T @ x @ BASIS
            plane = y.reshape(*blocks.shape[:2], 8, 8).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * 8, -1) + np.float32(128)
            if p.v != vmax:
                plane = plane.repeat(vmax // p.v, 0)
            if p.h != hmax:
                plane = plane.repeat(hmax // p.h, 1)
            planes.append(plane[: height - first * 8 * vmax, :width])
        if len(planes) == 1:
            planes *= 3
            rgb = planes
        else:
            y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
            # The colour transform of the JPEG file interchange format.
            rgb = (y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb)
        yield np.clip(np.rint(np.stack(rgb, -1)), 0, 255).astype(np.uint8)


def decode_rgb(media: bytes) -> np.ndarray:
    """The full-resolution RGB tensor (height, width, 3) of a progressive JPEG."""
    width, height, parts, quant, _ = read(media)
    return np.concatenate(list(strips(width, height, parts, quant)))


def payload_of(parts: list[Component], comment: bytes) -> bytes:
    """The bytes that encode() stored."""
    y, cb, cr = (p.blocks for p in parts)
    down, across = cb.shape[:2]
    luma = y.reshape(down, 2, across, 2, 64).transpose(0, 2, 1, 3, 4).reshape(down, across, 4, 64)
    grid = np.concatenate([luma, cb[:, :, None], cr[:, :, None]], 2)
    values = np.where(grid < 0, grid + 255, grid)
    values[..., 0] = grid[..., 0] + 128
    return values.astype(np.uint8).tobytes()[: struct.unpack(">Q", comment)[0]]


def feature(width: int, height: int, parts: list[Component], quant: dict[int, np.ndarray]) -> str:
    """Size, mean of each channel and mean step between neighbours, in hundredths, from the RGB tensor."""
    sums, steps, n = np.zeros(3, np.int64), 0, width * height
    for rgb in strips(width, height, parts, quant):
        sums += rgb.sum((0, 1), dtype=np.int64)
        g = rgb[:, :, 1].astype(np.int16)
        steps += int(np.abs(g[:, 1:] - g[:, :-1]).sum(dtype=np.int64))
    r, g, b = (int(100 * x // n) for x in sums)
    return f"{width}x{height};r={r};g={g};b={b};step={100 * steps // n}"


def store(docs: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds the text's payload as a progressive JPEG."""

    @F.arrow_udf("binary")
    def stored(texts: pa.Array) -> pa.Array:
        return pa.array([encode(padded(x.as_py() or b"")) for x in texts], pa.binary())

    return docs.withColumn(free_name(docs, out), stored(utf8(docs[text])))


def load_tensor(media: DataFrame, column: str = "media", out: str = "tensor") -> DataFrame:
    """Adds a struct of height, width and the RGB tensor's bytes, row by row."""
    kind = pa.struct([("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    @F.arrow_udf("struct<height:int,width:int,rgb:binary>")
    def loaded(files: pa.Array) -> pa.Array:
        rows = []
        for x in files:
            t = decode_rgb(x.as_py()) if x.is_valid else None
            rows.append(None if t is None else {"height": t.shape[0], "width": t.shape[1], "rgb": t.tobytes()})
        return pa.array(rows, kind)

    return media.withColumn(free_name(media, out), loaded(media[column]))


def digest(docs: DataFrame) -> DataFrame:
    """Per document: the payload read back from the stored file, and the file's digests and feature."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    kind = pa.struct([
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()),
    ])

    @F.arrow_udf("struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string>")
    def read_back(files: pa.Array) -> pa.Array:
        rows = []
        for x in files:
            media = x.as_py()
            width, height, parts, quant, comment = read(media)
            payload = payload_of(parts, comment)
            rows.append({
                "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]),
                "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(width, height, parts, quant),
            })
        return pa.array(rows, kind)

    stored = store(kept)
    done = stored.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), read_back("media").alias("m"))
    return done.select("doc_id", "n_bytes", "m.*")
