"""Image bytes to upright opaque RGB arrays, and PNG bytes back.

PNG and BMP are decoded here; JPEG, TIFF and WebP where an imaging library can
be imported, else JPEG and TIFF through the JVM's reader (``image`` source) and
WebP not at all. A failure raises ``ValueError`` with the reason.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Pixels above which a picture is refused as a decompression bomb (fixed value).
MOST_PIXELS = 89_478_485
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def on_white(rgb: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """RGB blended onto white by alpha, with rounded division by 255."""
    a = alpha.astype(np.int64)[..., None]
    t = rgb.astype(np.int64) * a + 255 * (255 - a) + 128
    return ((t + (t >> 8)) >> 8).astype(np.uint8)


def upright(image: np.ndarray, orientation: int) -> np.ndarray:
    """The image turned as its EXIF orientation says."""
    turns = {2: lambda x: x[:, ::-1], 3: lambda x: x[::-1, ::-1], 4: lambda x: x[::-1], 5: lambda x: x.swapaxes(0, 1), 6: lambda x: np.rot90(x, -1), 7: lambda x: x[::-1, ::-1].swapaxes(0, 1), 8: lambda x: np.rot90(x)}
    return np.ascontiguousarray(turns.get(orientation, lambda x: x)(image))


def exif_orientation(data: bytes) -> int:
    """Tag 0x0112 of a TIFF structure; 1 if it has none."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return 1
    at = struct.unpack(order + "I", data[4:8])[0]
    if at + 2 > len(data):
        return 1
    for k in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(order + "H", entry[8:10])[0]
    return 1


def jpeg_orientation(data: bytes) -> int:
    """The orientation of a JPEG's EXIF segment; 1 if it has none."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return exif_orientation(data[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def _unfilter(raw: bytes, rows: int, stride: int, step: int) -> np.ndarray:
    if len(raw) < rows * (stride + 1):
        raise ValueError("image file is truncated")
    out = np.zeros((rows, stride), dtype=np.uint8)
    above = np.zeros(stride, dtype=np.int64)
    for y in range(rows):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1).astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step]) & 255
        elif kind in (3, 4):
            for x in range(stride):
                left, up, corner = (line[x - step], above[x], above[x - step]) if x >= step else (0, above[x], 0)
                if kind == 3:
                    line[x] = line[x] + (left + up) // 2 & 255
                else:
                    guess = left + up - corner
                    line[x] = line[x] + min((left, up, corner), key=lambda v, g=guess: abs(g - v)) & 255
        elif kind:
            raise ValueError(f"unknown PNG filter {kind}")
        out[y], above = line, line
    return out


def _samples(raw: bytes, width: int, height: int, depth: int, channels: int) -> tuple[np.ndarray, int]:
    stride = -(-width * channels * depth // 8)
    lines = _unfilter(raw, height, stride, max(1, channels * depth // 8))
    if depth == 8:
        values = lines
    elif depth == 16:
        values = lines.reshape(height, -1, 2).astype(np.uint16)
        values = values[..., 0] << 8 | values[..., 1]
    else:
        bits = np.unpackbits(lines, axis=1)[:, : stride * 8].reshape(height, -1, depth)
        values = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(-1)
    return values[:, : width * channels].reshape(height, width, channels), height * (stride + 1)


def decode_png(data: bytes) -> np.ndarray:
    """A PNG of any colour type, depth and interlacing as RGB."""
    at, packed, palette, clear, turn, head, ended = 8, [], None, None, 1, None, False
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size].ljust(4, b"\0"))[0]:
            raise ValueError(f"broken PNG chunk {kind!r}")
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"eXIf":
            turn = exif_orientation(body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
            break
    if head is None or not packed or not ended:
        raise ValueError("image file is truncated")
    width, height, depth, colour, _, _, laced = head
    _check_size(width, height)
    if colour not in _CHANNELS:
        raise ValueError(f"unknown PNG colour type {colour}")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as error:
        raise ValueError(f"broken PNG data: {error}") from error
    channels = _CHANNELS[colour]
    if laced:
        values, used = np.zeros((height, width, channels), dtype=np.uint16), 0
        for x0, y0, dx, dy in _PASSES:
            w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
            if w > 0 and h > 0:
                values[y0::dy, x0::dx], n = _samples(raw[used:], w, h, depth, channels)
                used += n
    else:
        values, _ = _samples(raw, width, height, depth, channels)
    return upright(_png_rgb(values, depth, colour, palette, clear), turn)


def _png_rgb(values: np.ndarray, depth: int, colour: int, palette, clear) -> np.ndarray:
    if colour == 3:
        if palette is None or values.max(initial=0) >= len(palette):
            raise ValueError("PNG palette is missing or too short")
        rgb = palette[values[..., 0]]
        if clear is None:
            return rgb
        alpha = np.full(len(palette), 255, np.uint8)
        alpha[: min(len(clear), len(palette))] = np.frombuffer(clear[: len(palette)], np.uint8)
        return on_white(rgb, alpha[values[..., 0]])
    bytes_ = (values >> 8 if depth == 16 else values * (255 // ((1 << depth) - 1))).astype(np.uint8)
    alpha = None
    if colour in (4, 6):
        bytes_, alpha = bytes_[..., :-1], bytes_[..., -1]
    elif clear is not None:
        key = np.frombuffer(clear, ">u2")[: values.shape[-1]]
        alpha = np.where((values == key).all(-1), 0, 255).astype(np.uint8)
    rgb = np.repeat(bytes_, 3, axis=-1) if bytes_.shape[-1] == 1 else bytes_
    return on_white(rgb, alpha) if alpha is not None else np.ascontiguousarray(rgb)


def decode_bmp(data: bytes) -> np.ndarray:
    """An uncompressed BMP of 8, 24 or 32 bits as RGB."""
    if len(data) < 54:
        raise ValueError("image file is truncated")
    start, head, width, height = struct.unpack("<IIii", data[10:26])
    depth, packing = struct.unpack("<HI", data[28:34])
    _check_size(width, abs(height))
    if packing not in (0, 3) or depth not in (8, 24, 32) or width < 1 or height == 0:
        raise ValueError(f"unsupported BMP of {depth} bits, compression {packing}")
    stride = (width * depth // 8 + 3) // 4 * 4
    if len(data) < start + stride * abs(height):
        raise ValueError("image file is truncated")
    rows = np.frombuffer(data, np.uint8, stride * abs(height), start).reshape(abs(height), stride)[:, : width * depth // 8]
    pixels = rows.reshape(abs(height), width, depth // 8)[:: 1 if height < 0 else -1]
    if depth == 8:
        table = np.frombuffer(data, np.uint8, start - 14 - head, 14 + head).reshape(-1, 4)
        if pixels.max(initial=0) >= len(table):
            raise ValueError("BMP palette is too short")
        pixels = table[pixels[..., 0]]
    return np.ascontiguousarray(pixels[..., 2::-1])


def _check_size(width: int, height: int) -> None:
    if width * height > MOST_PIXELS:
        raise ValueError(f"image of {width * height} pixels exceeds the limit of {MOST_PIXELS}, a possible decompression bomb")


def decode(data: bytes) -> np.ndarray:
    """Upright opaque RGB of a picture's bytes, by what they begin with."""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return decode_png(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    try:
        from PIL import Image, ImageOps
    except ImportError:
        raise ValueError("no decoder for this format") from None
    import io

    with Image.open(io.BytesIO(data)) as found:
        _check_size(*found.size)
        turned = ImageOps.exif_transpose(found)
        if "A" in turned.getbands() or "transparency" in turned.info:
            full = np.asarray(turned.convert("RGBA"))
            return on_white(full[..., :3], full[..., 3])
        return np.asarray(turned.convert("RGB"))


def from_jvm(data: bytes, width: int, height: int, channels: int, orientation: int) -> np.ndarray:
    """A row of Spark's image source (BGR, BGRA or gray) as RGB."""
    if width < 1 or height < 1:
        raise ValueError("no decoder for this format")
    _check_size(width, height)
    pixels = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        rgb = np.repeat(pixels, 3, axis=-1)
    else:
        rgb = pixels[..., 2::-1]
        if channels == 4:
            rgb = on_white(rgb, pixels[..., 3])
    return upright(rgb, orientation)


def png_bytes(image: np.ndarray) -> bytes:
    """RGB as an unfiltered PNG."""
    if image.ndim != 3 or image.shape[2] != 3 or image.dtype != np.uint8:
        raise ValueError("PNG encoding requires an RGB image")
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    height, width = image.shape[:2]
    raw = np.concatenate([np.zeros((height, 1), np.uint8), image.reshape(height, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")
