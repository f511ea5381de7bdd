"""Grey pixels from image files: PGM, PPM and PNG by their formats, others by Pillow where it is installed."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:  # width, height, greatest value, with comments between
        while data[at : at + 1].isspace():
            at += 1
        end = data.index(b"\n", at) if data[at : at + 1] == b"#" else at
        if end > at:
            at = end
            continue
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    channels = 3 if data[1:2] == b"6" else 1
    kind = np.uint8 if most < 256 else np.dtype(">u2")
    pixels = np.frombuffer(data, kind, width * height * channels, at + 1).astype(float) * (255 / most)
    return pixels.reshape(height, width, channels)


def _png(data: bytes) -> np.ndarray:
    at, body, palette = 8, b"", None
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            width, height, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", chunk)
        elif name == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            body += chunk
        at += 12 + size
    if depth != 8 or interlaced:
        raise ValueError("only PNG of 8 bits without interlacing")
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    rows = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width * channels), np.uint8)
    above = np.zeros(width * channels, np.int64)
    for y, row in enumerate(rows):
        kind, line = int(row[0]), row[1:].astype(np.int64)
        if kind == 2:
            line = line + above
        elif kind == 1:
            line = np.cumsum(line.reshape(width, channels), axis=0).ravel()
        elif kind:
            for i in range(len(line)):
                left, corner = (line[i - channels], above[i - channels]) if i >= channels else (0, 0)
                if kind == 3:
                    guess = (left + above[i]) // 2
                else:
                    near = [(abs(above[i] - corner), 0, left), (abs(left - corner), 1, above[i]), (abs(left + above[i] - 2 * corner), 2, corner)]
                    guess = min(near)[2]
                line[i] = (line[i] + guess) & 255
        above = line & 255
        out[y] = above
    if colour == 3:
        return palette[out].astype(float)
    pixels = out.reshape(height, width, channels).astype(float)
    return pixels[..., :1] if colour == 4 else pixels[..., :3]


def _shares(n: int, size: int) -> np.ndarray:
    """size x n: the share of each of n pixels in each of size equal parts of their length."""
    edges, at = np.linspace(0, n, size + 1), np.arange(n)
    covered = np.minimum(edges[1:, None], at + 1) - np.maximum(edges[:-1, None], at)
    return np.clip(covered, 0, None) * size / n


def grey(content: bytes | None, size: int = 8) -> tuple[list[float] | None, str | None]:
    """(size x size grey values by rows, null) or (null, what is wrong). Sizes change by the mean of what a pixel covers; Pillow files by its own filter."""
    try:
        if content and content[:2] in (b"P5", b"P6"):
            pixels = _netpbm(content)
        elif content and content[:8] == b"\x89PNG\r\n\x1a\n":
            pixels = _png(content)
        else:
            import io

            from PIL import Image

            return [float(v) for v in Image.open(io.BytesIO(content or b"")).convert("L").resize((size, size), Image.LANCZOS).getdata()], None
    except ModuleNotFoundError:
        return None, "Pillow is not installed"
    except Exception as e:  # a broken file is a row with an error, not a failed job
        return None, f"{type(e).__name__}: {e}"[:200]
    if pixels.shape[2] == 3:
        pixels = pixels @ np.array([0.299, 0.587, 0.114])
    else:
        pixels = pixels[..., 0]
    return (_shares(pixels.shape[0], size) @ pixels @ _shares(pixels.shape[1], size).T).ravel().tolist(), None
