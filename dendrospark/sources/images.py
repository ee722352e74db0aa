"""PNG images as rows: reading, writing, intensities, and manifests joined with their images.

The decoder walks the chunks, inflates the data and undoes the scanline filters
with numpy: a row that depends on the row above only, or on its own left
neighbour by addition, in one operation; the other two filters along the
diagonals of the image, all rows of a diagonal at a time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.match import by_candidates

# Fixed values of the format: signature, samples a pixel by colour type, and the seven passes of an interlaced image (first column and row, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
MOST_PIXELS = 1 << 28
BATCH = 1 << 22  # bytes of pixels, from which on a batch of images is passed on

IMAGE = "path string, height int, width int, channels int, bits int, pixels binary, problem string"


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk; a wrong checksum or a cut file is an error."""
    if data[:8] != SIGNATURE:
        raise ValueError("no PNG signature")
    at = 8
    while True:
        head = data[at : at + 8]
        if len(head) < 8:
            raise ValueError("the file ends before its last chunk")
        size, kind = struct.unpack(">I4s", head)
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            raise ValueError(f"a damaged chunk at byte {at}")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size


def unfiltered(lines: np.ndarray, step: int) -> np.ndarray:
    """Bytes of scanlines (a filter byte each, then data) before filtering; ``step`` is the bytes to the left neighbour."""
    kinds, data = lines[:, 0], lines[:, 1:]
    h, n = len(data), data.shape[1] // step
    if h and kinds.max() > 4:
        raise ValueError("an unknown filter")
    data = data.reshape(h, n, step)
    if not np.isin(kinds, (3, 4)).any():
        out = np.zeros((h + 1, n, step), np.uint8)
        for r in range(h):
            out[r + 1] = np.cumsum(data[r], axis=0, dtype=np.uint8) if kinds[r] == 1 else data[r] + (out[r] if kinds[r] == 2 else np.uint8(0))
        return out[1:].reshape(h, -1)
    out = np.zeros((h + 1, n + 1, step), np.int16)
    for k in range(h + n - 1):
        r = np.arange(max(0, k - n + 1), min(h, k + 1))
        c = k - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        away = up - corner, left - corner, left + up - 2 * corner
        near = [np.abs(a) for a in away]
        nearest = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
        guess = np.stack([np.zeros_like(left), left, up, (left + up) >> 1, nearest])
        out[r + 1, c + 1] = (data[r, c] + guess[kinds[r], np.arange(len(r))]) & 255
    return out[1:, 1:].reshape(h, -1).astype(np.uint8)


def samples(raw: np.ndarray, width: int, bits: int, count: int) -> np.ndarray:
    """Samples (rows, width, count) of unfiltered scanlines."""
    if bits == 16:
        return raw.view(">u2").astype(np.uint16).reshape(len(raw), width, count)
    if bits < 8:
        parts = np.unpackbits(raw, axis=1).reshape(len(raw), -1, bits)
        raw = (parts @ (1 << np.arange(bits)[::-1])).astype(np.uint8)[:, : width * count]
    return raw.reshape(len(raw), width, count)


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, channels), 8 or 16 bits. Palettes become colours (with their alpha, where they have it), grey levels of under 8 bits are spread over 0 to 255."""
    head = palette = alpha = None
    packed = []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None:
        raise ValueError("no header chunk")
    width, height, bits, colour, _, _, interlaced = head
    if colour not in SAMPLES or bits not in (1, 2, 4, 8, 16) or not 0 < width * height <= MOST_PIXELS:
        raise ValueError("an unknown kind of image, or one too large")
    count = SAMPLES[colour]
    grids = PASSES if interlaced else ((0, 0, 1, 1),)
    shapes = [(-(-(height - y) // dy) if height > y else 0, -(-(width - x) // dx) if width > x else 0) for x, y, dx, dy in grids]
    sizes = [h * (1 + -(-w * count * bits // 8)) if h and w else 0 for h, w in shapes]
    raw = zlib.decompressobj().decompress(b"".join(packed), sum(sizes) + 1)
    if len(raw) != sum(sizes):
        raise ValueError("as many bytes as the header says are not there")
    out = np.zeros((height, width, count), np.uint16 if bits == 16 else np.uint8)
    at = 0
    for (x, y, dx, dy), (h, w), size in zip(grids, shapes, sizes, strict=True):
        if size:
            lines = np.frombuffer(raw, np.uint8, size, at).reshape(h, -1)
            out[y::dy, x::dx] = samples(unfiltered(lines, max(1, bits * count // 8)), w, bits, count)
            at += size
    if colour == 3:
        if palette is None or out.max(initial=0) >= len(palette):
            raise ValueError("a colour that the palette doesn't have")
        if alpha is not None:
            palette = np.c_[palette, np.r_[alpha, np.full(256, 255, np.uint8)][: len(palette)]]
        return palette[out[:, :, 0]]
    return out * np.uint8(255 // ((1 << bits) - 1)) if bits < 8 else out


def encode(pixels: np.ndarray, filters: tuple[int, ...] = (0,)) -> bytes:
    """A PNG of pixels (height, width, channels) of 8 or 16 bits; row r uses filter ``filters[r % len(filters)]``."""
    height, width, count = pixels.shape
    wide = pixels.dtype.itemsize == 2
    raw = (pixels.astype(">u2").view(np.uint8) if wide else pixels.astype(np.uint8)).reshape(height, -1)
    step = count * (2 if wide else 1)
    old = np.pad(raw.astype(np.int16), ((1, 0), (step, 0)))
    left, up, corner = old[1:, :-step], old[:-1, step:], old[:-1, :-step]
    near = [np.abs(a) for a in (up - corner, left - corner, left + up - 2 * corner)]
    nearest = np.where((near[0] <= near[1]) & (near[0] <= near[2]), left, np.where(near[1] <= near[2], up, corner))
    guess = np.stack([np.zeros_like(left), left, up, (left + up) >> 1, nearest])
    kinds = np.resize(np.array(filters), height)
    lines = np.c_[kinds, (raw - guess[kinds, np.arange(height)]) & 255].astype(np.uint8)
    colour = next(k for k, n in SAMPLES.items() if n == count and k != 3)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 16 if wide else 8, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decoded(files: DataFrame) -> DataFrame:
    """(path, height, width, channels, bits, pixels, problem) of (path, content). ``pixels`` holds rows, in them pixels, in them channels, little-endian. A file that can't be decoded has its ``problem`` and no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), *((c, pa.int32()) for c in ("height", "width", "channels", "bits")), ("pixels", pa.binary()), ("problem", pa.string())])
        table = lambda rows: pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        for batch in batches:
            made, held = [], 0
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    a = decode(content.as_py() or b"")
                    row = [*a.shape, 8 * a.dtype.itemsize, a.astype(a.dtype.newbyteorder("<")).tobytes(), None]
                except (ValueError, zlib.error, struct.error) as error:
                    row = [None, None, None, None, None, str(error)]
                made.append([path.as_py(), *row])
                held += len(row[4] or b"")
                if held >= BATCH:
                    yield table(made)
                    made, held = [], 0
            if made:
                yield table(made)

    return files.select("path", "content").mapInArrow(run, IMAGE)


def png_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, content, ...) of all PNG files below the paths. Files without a byte have no row: Spark passes over them."""
    paths = [path] if isinstance(path, str) else path
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][nN][gG]").load(paths)


def read_png(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All PNG files below the paths, one row each; see ``decoded`` and ``png_files``."""
    return decoded(png_files(spark, path))


def encoded(images: DataFrame, filters: tuple[int, ...] = (0,)) -> DataFrame:
    """(name, content): PNG files of (name, height, width, channels, bits, pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("name", "height", "width", "channels", "bits", "pixels")), strict=True)
            files = [encode(np.frombuffer(p, "<u2" if bits == 16 else np.uint8).reshape(h, w, c), filters) for _, h, w, c, bits, p in rows]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(files, pa.binary())], names=["name", "content"])

    return images.mapInArrow(run, "name string, content binary")


def intensities(images: DataFrame) -> DataFrame:
    """Images with ``values``, a number a pixel: the mean of its channels (alpha too) by 255; null where there are no pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("channels", "bits", "pixels")), strict=True)
            values = [None if p is None else np.frombuffer(p, "<u2" if bits == 16 else np.uint8).reshape(-1, n).mean(axis=1, dtype=np.float32) / np.float32(255) for n, bits, p in rows]
            keep = [n for n in batch.schema.names if n != "pixels"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(values, pa.list_(pa.float32()))], names=[*keep, "values"])

    rest = ", ".join(f"{c} {t}" for c, t in images.dtypes if c != "pixels")
    return images.mapInArrow(run, f"{rest}, values array<float>")


def file_candidates(path: Column) -> Column:
    """Where a manifest's path may be, in this order: as it stands, then with ``images/`` before it, or without it."""
    return F.array(path, F.when(path.startswith("images/"), F.substr(path, F.lit(8))).otherwise(F.concat(F.lit("images/"), path)))


def with_images(manifest: DataFrame, images: DataFrame, root: str, key: str, files: DataFrame | None = None) -> DataFrame:
    """Manifest rows with the image that their ``mask_bw``, else their ``image``, names below ``root``. Rows that name none are an error; rows whose file isn't there go.

    ``files`` (path), where given, lists the images' files, so that none is decoded to learn which are there.
    """
    named = [F.col(c) for c in ("mask_bw", "image") if c in manifest.columns]
    path = F.coalesce(*named, F.raise_error(F.lit("an entry without mask_bw or image")))
    base = root.rstrip("/") + "/"
    relative = F.expr(f"substring(path, instr(path, '{base.removeprefix('file://').removeprefix('file:')}') + {len(base.removeprefix('file://').removeprefix('file:'))})")
    return by_candidates(manifest, key, file_candidates(path), images.withColumn("file", relative).drop("path"), "file", None if files is None else files.select(relative.alias("file")))
