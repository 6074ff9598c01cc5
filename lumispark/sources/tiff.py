"""TIFF pages in numpy: reading and writing of multi-page stacks, without other libraries.

Reads both byte orders, strips of any size, uncompressed, deflate (both codes) and PackBits, with or
without horizontal differencing, unsigned, signed and float samples, grey or with samples side by
side. Pages appended by one contiguous block after the first directory (large stacks of one image
tool) are found by the count in its description.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

#: Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, DESCRIPTION = 256, 257, 258, 259, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 273, 277, 278, 279
X_RESOLUTION, Y_RESOLUTION, PREDICTOR, SAMPLE_FORMAT, METADATA = 282, 283, 317, 339, 50839
#: Struct code and size of each field type.
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 10: ("ii", 8), 11: ("f", 4), 12: ("d", 8)}


class Ranges:
    """A file as bytes of which only the slices that are asked for are read; `bytes_read` adds them up."""

    def __init__(self, file: BinaryIO):
        self.file, self.bytes_read = file, 0
        self.size = file.seek(0, 2)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, at: slice) -> bytes:
        low, high, _ = at.indices(self.size)
        self.file.seek(low)
        out = self.file.read(max(0, high - low))
        self.bytes_read += len(out)
        return out


@dataclass
class Page:
    tags: dict[int, object]
    order: str
    data: bytes | Ranges = field(repr=False)

    @property
    def shape(self) -> tuple[int, int]:
        return int(_one(self.tags[HEIGHT])), int(_one(self.tags[WIDTH]))

    def array(self) -> np.ndarray:
        """The page's samples: (height, width), with a last axis where there are several a pixel."""
        height, width = self.shape
        samples = int(_one(self.tags.get(SAMPLES, 1)))
        bits = int(_one(self.tags.get(BITS, 8)))
        kind = {1: "u", 2: "i", 3: "f"}[int(_one(self.tags.get(SAMPLE_FORMAT, 1)))]
        if bits not in (8, 16, 32, 64):
            raise ValueError(f"{bits} bits a sample")
        dtype = np.dtype(f"{self.order}{kind}{bits // 8}")
        compression, rows = int(_one(self.tags.get(COMPRESSION, 1))), int(_one(self.tags.get(ROWS_PER_STRIP, height)))
        parts, left = [], height
        for at, size in zip(_many(self.tags[STRIP_OFFSETS]), _many(self.tags[STRIP_BYTES])):
            raw = _unpacked(self.data[at : at + size], compression)
            count = min(rows, left)
            strip = np.frombuffer(raw, dtype, count * width * samples).reshape(count, width, samples)
            if int(_one(self.tags.get(PREDICTOR, 1))) == 2:
                strip = np.cumsum(strip, axis=1, dtype=dtype.newbyteorder("="))
            parts.append(strip.astype(dtype.newbyteorder("="), copy=False))
            left -= count
        out = np.concatenate(parts) if parts else np.zeros((height, width, samples), dtype)
        return out[:, :, 0] if samples == 1 else out


def _one(value):
    return value[0] if isinstance(value, (tuple, list)) else value


def _many(value) -> list[int]:
    return list(value) if isinstance(value, (tuple, list)) else [value]


def _unpacked(raw: bytes, compression: int) -> bytes:
    if compression == 1:
        return raw
    if compression in (8, 32946):
        return zlib.decompress(raw)
    if compression == 32773:
        out, at = bytearray(), 0
        while at < len(raw):
            n = raw[at]
            if n < 128:
                out += raw[at + 1 : at + 2 + n]
                at += n + 2
            else:
                out += raw[at + 1 : at + 2] * (257 - n if n > 128 else 0)
                at += 2 if n > 128 else 1
        return bytes(out)
    raise ValueError(f"compression {compression}")


def _fields(form: str, data: bytes | Ranges, at: int) -> tuple:
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def read_pages(data: bytes | Ranges) -> list[Page]:
    """Directories of a file, in order. Samples are read when a page's array is asked for."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or _fields(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    pages, at, seen = [], _fields(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (count,) = _fields(order + "H", data, at)
        directory = data[at + 2 : at + 6 + 12 * count]
        tags: dict[int, object] = {}
        for k in range(count):
            tag, kind, many = struct.unpack_from(order + "HHI", directory, 12 * k)
            if kind not in FIELDS:
                continue
            code, size = FIELDS[kind]
            raw = directory[12 * k + 8 : 12 * k + 12]
            if size * many > 4:
                (place,) = struct.unpack(order + "I", raw)
                raw = data[place : place + size * many]
            if kind == 2:
                tags[tag] = raw[:many].split(b"\0")[0].decode("latin-1")
            elif kind in (5, 10):
                flat = struct.unpack_from(order + code * many, raw)
                tags[tag] = tuple(zip(flat[::2], flat[1::2]))
            else:
                tags[tag] = struct.unpack_from(f"{order}{many}{code}", raw)
        pages.append(Page(tags, order, data))
        (at,) = struct.unpack_from(order + "I", directory, 12 * count)
    return pages + _appended(pages, data)


def _appended(pages: list[Page], data: bytes | Ranges) -> list[Page]:
    """Further planes that follow the only page's samples without directories of their own."""
    text = description(pages[0]) if len(pages) == 1 else ""
    many = int(next((line[7:] for line in text.splitlines() if line.startswith("images=") and line[7:].isdigit()), 1))
    if many < 2 or int(_one(pages[0].tags.get(COMPRESSION, 1))) != 1:
        return []
    size = sum(_many(pages[0].tags[STRIP_BYTES]))
    first = _many(pages[0].tags[STRIP_OFFSETS])[0]
    height, _ = pages[0].shape
    found = []
    for k in range(1, many):
        if first + (k + 1) * size > len(data):
            break
        found.append(Page({**pages[0].tags, STRIP_OFFSETS: first + k * size, STRIP_BYTES: size, ROWS_PER_STRIP: height}, pages[0].order, data))
    return found


def description(page: Page) -> str:
    return str(page.tags.get(DESCRIPTION, "") or "")


def settings(page: Page) -> dict[str, str]:
    """name=value lines of the description."""
    return dict(line.split("=", 1) for line in description(page).splitlines() if "=" in line)


def metadata(page: Page) -> str:
    """Text of the private metadata block, whichever width its letters have."""
    raw = bytes(_many(page.tags.get(METADATA, ())))
    return raw.replace(b"\0", b"").decode("latin-1")


def named_tags(page: Page) -> dict[str, str]:
    """Tags as text, under the names that the spacing rules use."""
    out = {"ImageDescription": description(page), "IJMetadata": metadata(page)}
    for name, tag in (("XResolution", X_RESOLUTION), ("YResolution", Y_RESOLUTION)):
        if tag in page.tags:
            a, b = _one(page.tags[tag])
            out[name] = f"{a}/{b}"
    return {k: v for k, v in out.items() if v}


def spacing(page: Page) -> tuple[float | None, float | None, float | None]:
    """(x, y, z) size of a voxel: x and y as the inverse of the resolution; z from the metadata's third
    nscales entry, else from spacing= in the description; null where the file doesn't say."""
    across = []
    for tag in (X_RESOLUTION, Y_RESOLUTION):
        a, b = _one(page.tags.get(tag, ((0, 0),)))
        across.append(b / a if a and b else None)
    step = None
    found = metadata(page).split("nscales=")
    parts = found[1].splitlines()[0].split(",") if len(found) > 1 and found[1] else []
    for text in (parts[2] if len(parts) > 2 else "", settings(page).get("spacing", "")):
        try:
            step = float(text.split()[0]) if step is None and text.strip() else step
        except ValueError:
            pass
    return across[0], across[1], step


def write_stack(stack: np.ndarray, text: str = "", px_um: float | None = None) -> bytes:
    """A little-endian multi-page file of a (pages, height, width) stack, deflate-compressed."""
    kind = {"u": 1, "i": 2, "f": 3}[stack.dtype.kind]
    out, ends = bytearray(b"II" + struct.pack("<HI", 42, 0)), 4
    for number, plane in enumerate(stack):
        raw = zlib.compress(np.ascontiguousarray(plane.astype(stack.dtype.newbyteorder("<"))).tobytes())
        at = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        entries = [(WIDTH, 4, plane.shape[1]), (HEIGHT, 4, plane.shape[0]), (BITS, 3, stack.dtype.itemsize * 8), (COMPRESSION, 3, 8), (262, 3, 1)]
        note = (text + "\0").encode("latin-1") if text and not number else b""
        if note:
            entries.append((DESCRIPTION, 2, note))
        entries += [(STRIP_OFFSETS, 4, at), (SAMPLES, 3, 1), (ROWS_PER_STRIP, 4, plane.shape[0]), (STRIP_BYTES, 4, len(raw))]
        if px_um:
            entries += [(X_RESOLUTION, 5, (1_000_000, round(px_um * 1_000_000))), (Y_RESOLUTION, 5, (1_000_000, round(px_um * 1_000_000)))]
        entries.append((SAMPLE_FORMAT, 3, kind))
        packed = []
        for tag, field_type, value in entries:
            if field_type == 2 and len(value) > 4 or field_type == 5:
                place = len(out)
                body = value if field_type == 2 else struct.pack("<II", *value)
                out += body + b"\0" * (len(body) % 2)
                packed.append(struct.pack("<HHII", tag, field_type, len(value) if field_type == 2 else 1, place))
            elif field_type == 2:
                packed.append(struct.pack("<HHI4s", tag, 2, len(value), value))
            else:
                packed.append(struct.pack("<HHI", tag, field_type, 1) + struct.pack("<I" if field_type == 4 else "<HH", *((value,) if field_type == 4 else (value, 0))))
        struct.pack_into("<I", out, ends, len(out))
        out += struct.pack("<H", len(packed)) + b"".join(packed) + b"\0\0\0\0"
        ends = len(out) - 4
    return bytes(out)
