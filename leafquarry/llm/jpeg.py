"""Media columns as progressive JPEG.

A payload's bytes are stored as quantised coefficients (the format's unit), 64 to a block, of a 4:2:0 image: first
by spectral selection with the last bit left out (successive approximation), then that bit. The decoder
accumulates any such scans into coefficient arrays, transforms them back in numpy, upsamples chroma and gives the
full-resolution RGB tensor; the payload is read back from the coefficients, without loss.

Each byte b becomes a coefficient of magnitude category 7 in the first scan (its high seven bits are exactly the
category's bits) and one refining bit, so every Huffman table has one symbol and numpy can read a scan at once. Files
with other tables take the decoder's symbol-by-symbol path.

Media and tensors are Parquet columns in the shared folder (``store``, ``kept``); features are computed from what is read back.

Defined cases: a null or empty text is one block of zero bytes; null ids stay null; very long texts are stored whole; equal texts give equal files; repeated rows stay; an empty
table gives an empty result; columns beyond doc_id and text are ignored. An image holds at most 4095 x 4095 units
(6.4 GB of payload); beyond that ``encode`` raises ValueError.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquarry.llm.common import bound_batches, new_folder, pick

#: Coefficients 1-31 and 32-63 have scans of their own.
BANDS = ((1, 31), (32, 63))
QUANT = 4


def zigzag() -> np.ndarray:
    """Place (row * 8 + column) of each coefficient in order of the diagonals."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = zigzag()


def _transform() -> np.ndarray:
    """64 x 64: samples = coefficients (in zigzag order) @ matrix."""
    k, x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
    basis = np.cos((2 * x + 1) * k * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)
    return np.kron(basis, basis)[ZIGZAG].astype(np.float32)


INVERSE = _transform()


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (64 if not raw else -len(raw) % 64)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def huffman(kind: int, symbol: int) -> bytes:
    """A table with one symbol, of code 0."""
    return segment(0xC4, bytes([kind << 4, 1, *[0] * 15, symbol]))


def scan(component: int, first: int, last: int, high: int, low: int, data: bytes) -> bytes:
    return segment(0xDA, bytes([1, component, 0, first, last, high << 4 | low])) + data


def stuffed(bits: np.ndarray) -> bytes:
    """Bits as entropy-coded bytes: filled up with ones, 0 after each 255."""
    bits = np.concatenate((bits.ravel(), np.ones(-bits.size % 8, np.uint8)))
    return np.packbits(bits).tobytes().replace(b"\xff", b"\xff\0")


def layout(n_blocks: int) -> tuple[int, int]:
    """Units (of six blocks) across and down."""
    units = -(-n_blocks // 6)
    across = int(np.ceil(np.sqrt(units)))
    down = -(-units // across)
    if max(across, down) > 4095:
        raise ValueError("the payload doesn't fit an image")
    return across, down


def encode(payload: bytes) -> bytes:
    """The JPEG file of a payload whose length is a positive multiple of 64. Blocks are dealt to Y, then Cb, then Cr."""
    n = len(payload) // 64
    across, down = layout(n)
    units = across * down
    blocks = np.zeros((6 * units, 64), np.uint8)
    blocks[:n] = np.frombuffer(payload, np.uint8).reshape(n, 64)
    high, low = blocks >> 1, blocks & 1
    own = ((1, slice(0, 4 * units)), (2, slice(4 * units, 5 * units)), (3, slice(5 * units, 6 * units)))
    out = [
        b"\xff\xd8",
        segment(0xFE, b"blocks %d" % n),
        segment(0xDB, bytes([0]) + bytes([QUANT]) * 64),
        segment(0xC2, struct.pack(">BHHB", 8, 16 * down, 16 * across, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])),
        huffman(0, 7),
        huffman(1, 7),
        segment(0xDD, struct.pack(">H", 1)),
    ]
    for c, s in own:  # a restart after each block resets the prediction: code 0 and seven bits are one byte
        dc = np.empty((len(high[s]), 3), np.uint8)
        dc[:, 0], dc[:, 1], dc[:, 2] = high[s, 0], 0xFF, 0xD0 + np.arange(len(dc)) % 8
        out.append(scan(c, 0, 0, 0, 1, dc.tobytes()[:-2]))
    out.append(segment(0xDD, struct.pack(">H", 0)))
    for a, b in BANDS:
        out += [scan(c, a, b, 0, 1, high[s, a : b + 1].tobytes()) for c, s in own]
    out += [scan(c, 0, 0, 1, 0, stuffed(low[s, 0])) for c, s in own]
    out.append(huffman(1, 0))
    for a, b in BANDS:
        for c, s in own:
            bits = np.zeros((len(low[s]), b - a + 2), np.uint8)  # the code of "end of block", then the refining bits
            bits[:, 1:] = low[s, a : b + 1]
            out.append(scan(c, a, b, 1, 0, stuffed(bits)))
    return b"".join((*out, b"\xff\xd9"))


@dataclass
class Image:
    height: int = 0
    width: int = 0
    comment: bytes = b""
    quant: dict = field(default_factory=dict)
    sampling: list = field(default_factory=list)  # id, across, down, quantiser
    tables: dict = field(default_factory=dict)  # (kind, id): {(length, code): symbol}
    coefficients: list = field(default_factory=list)  # of each component: rows, columns, 64
    restart: int = 0

    def grid(self, k: int) -> tuple[int, int]:
        """Blocks down and across that a scan of the component alone has."""
        most_x, most_y = max(s[1] for s in self.sampling), max(s[2] for s in self.sampling)
        _, x, y, _ = self.sampling[k]
        return -(-(-(-self.height * y // most_y)) // 8), -(-(-(-self.width * x // most_x)) // 8)


class Bits:
    """Bits of entropy-coded data without stuffing."""

    def __init__(self, raw: bytes):
        self.bits = np.unpackbits(np.frombuffer(raw, np.uint8)).tolist()
        self.at = 0

    def bit(self) -> int:
        self.at += 1
        return self.bits[self.at - 1] if self.at <= len(self.bits) else 1

    def number(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out

    def signed(self, n: int) -> int:
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def symbol(self, table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.bit()
            if (length, code) in table:
                return table[length, code]
        raise ValueError("no such code")


def _signed7(f: np.ndarray) -> np.ndarray:
    f = f.astype(np.int16)
    return np.where(f >= 64, f, f - 127)


def _at_once(image: Image, k: int, a: int, b: int, high: int, low: int, data: bytes, dc: dict, ac: dict) -> bool:
    """Reads a scan of one component by numpy where its one-symbol tables allow it; says whether they did."""
    rows, across = image.grid(k)
    whole = image.coefficients[k]
    if whole.shape[:2] != (rows, across):
        return False
    flat, n = whole.reshape(rows * across, 64), rows * across
    if a == 0 and not high and dc == {(1, 0): 7} and image.restart == 1 and len(data) == 3 * n - 2:
        flat[:, 0] = _signed7(np.frombuffer(data + b"\0\0", np.uint8).reshape(n, 3)[:, 0]) << low
        return True
    if a and not high and ac == {(1, 0): 7} and not image.restart and len(data) == n * (b - a + 1):
        v = _signed7(np.frombuffer(data, np.uint8).reshape(n, -1))
        flat[:, a : b + 1] = np.sign(v) * (np.abs(v) << low)
        return True
    if high and not image.restart:
        bits = np.unpackbits(np.frombuffer(data.replace(b"\xff\0", b"\xff"), np.uint8))
        if a == 0:
            flat[:, 0] |= bits[:n].astype(np.int16) << low
            return True
        old = flat[:, a : b + 1]
        if ac == {(1, 0): 0} and old.all() and bits.size >= n * (b - a + 2):
            flat[:, a : b + 1] += np.sign(old) * (bits[: n * (b - a + 2)].reshape(n, -1)[:, 1:].astype(np.int16) << low)
            return True
    return False


def _block(bits: Bits, block: np.ndarray, a: int, b: int, high: int, low: int, dc: dict, ac: dict, state: dict, k: int) -> None:
    """One block of a scan, as the standard's progressive procedures have it (ITU-T T.81, annex G)."""
    if a == 0:
        if high:
            block[0] |= bits.bit() << low
        else:
            state[k] = state.get(k, 0) + bits.signed(bits.symbol(dc))
            block[0] = state[k] << low
        return
    at, step = a, 1 << low

    def refine(p: int) -> None:
        if bits.bit():
            block[p] += step if block[p] > 0 else -step

    if not state.get("run"):
        while at <= b:
            zeros, size = divmod(bits.symbol(ac), 16)
            if size == 0 and zeros < 15:
                state["run"] = (1 << zeros) + bits.number(zeros)
                break
            value = bits.signed(size) * step if size else 0
            if not high:
                at += zeros
                if size:
                    block[at] = value
                at += 1
                continue
            while at <= b:
                if block[at]:
                    refine(at)
                elif zeros == 0:
                    block[at] = value
                    at += 1
                    break
                else:
                    zeros -= 1
                at += 1
    if state.get("run"):
        if high:
            for p in range(at, b + 1):
                if block[p]:
                    refine(p)
        state["run"] -= 1


def _scan(image: Image, which: list[tuple[int, dict, dict]], a: int, b: int, high: int, low: int, data: bytes) -> None:
    if len(which) == 1 and _at_once(image, which[0][0], a, b, high, low, data, which[0][1], which[0][2]):
        return
    pieces, last, at = [], 0, data.find(b"\xff")
    while at >= 0:
        if 0xD0 <= data[at + 1] <= 0xD7:
            pieces.append(data[last:at])
            last = at + 2
        at = data.find(b"\xff", at + 2)
    pieces.append(data[last:])
    if len(which) == 1:
        rows, across = image.grid(which[0][0])
        order = [[(which[0], r, c)] for r in range(rows) for c in range(across)]
    else:
        order = []
        _, x0, y0, _ = image.sampling[which[0][0]]
        down, wide = (n // f for n, f in zip(image.coefficients[which[0][0]].shape, (y0, x0), strict=False))
        for my in range(down):
            for mx in range(wide):
                order.append([(w, my * image.sampling[w[0]][2] + v, mx * image.sampling[w[0]][1] + u) for w in which for v in range(image.sampling[w[0]][2]) for u in range(image.sampling[w[0]][1])])
    state: dict = {}
    bits = None
    for n, unit in enumerate(order):
        if bits is None or image.restart and n % image.restart == 0:
            bits, state = Bits(pieces.pop(0).replace(b"\xff\0", b"\xff")), {}
        for (k, dc, ac), r, c in unit:
            _block(bits, image.coefficients[k][r, c], a, b, high, low, dc, ac, state, k)


def read(media: bytes) -> Image:
    """The image with all scans accumulated. Raises ValueError for what isn't a progressive JPEG of 8 bits."""
    image, at = Image(), 2
    if media[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    while True:
        marker, n = media[at + 1], int.from_bytes(media[at + 2 : at + 4], "big")
        if marker == 0xD9:
            return image
        body, at = media[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            image.comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                image.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xDD:
            (image.restart,) = struct.unpack(">H", body)
        elif marker == 0xC4:
            while body:
                counts, code, place, table = body[1:17], 0, 17, {}
                for length, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[length, code] = body[place]
                        code, place = code + 1, place + 1
                    code <<= 1
                image.tables[body[0] >> 4, body[0] & 15] = table
                body = body[place:]
        elif marker == 0xC2:
            bits, image.height, image.width, count = struct.unpack(">BHHB", body[:6])
            if bits != 8:
                raise ValueError("only 8 bits a sample")
            image.sampling = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(count)]
            most_x, most_y = max(s[1] for s in image.sampling), max(s[2] for s in image.sampling)
            down, across = -(-image.height // (8 * most_y)), -(-image.width // (8 * most_x))
            image.coefficients = [np.zeros((down * y, across * x, 64), np.int16) for _, x, y, _ in image.sampling]
        elif 0xC0 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only progressive files with Huffman codes")
        elif marker == 0xDA:
            end = at
            while True:
                end = media.index(b"\xff", end)
                if media[end + 1] and not 0xD0 <= media[end + 1] <= 0xD7:
                    break
                end += 2
            ids = [s[0] for s in image.sampling]
            which = [
                (ids.index(body[1 + 2 * k]), image.tables.get((0, body[2 + 2 * k] >> 4), {}), image.tables.get((1, body[2 + 2 * k] & 15), {})) for k in range(body[0])
            ]
            first, last, approx = body[1 + 2 * body[0] : 4 + 2 * body[0]]
            _scan(image, which, first, last, approx >> 4, approx & 15, media[at:end])
            at = end


def tensor(image: Image) -> np.ndarray:
    """height x width x 3 of 8 bits: inverse transform, upsampled chroma, colours."""
    most_x, most_y = max(s[1] for s in image.sampling), max(s[2] for s in image.sampling)
    planes = []
    for (_, x, y, q), c in zip(image.sampling, image.coefficients, strict=True):
        rows, across = c.shape[:2]
        samples = (c.reshape(-1, 64) * image.quant[q]) @ INVERSE
        plane = np.clip(samples + 128, 0, 255).reshape(rows, across, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * across)
        plane = plane.repeat(most_y // y, axis=0).repeat(most_x // x, axis=1)
        planes.append(plane[: image.height, : image.width])
    if len(planes) == 1:
        planes *= 3
        return np.rint(np.stack(planes, axis=2)).astype(np.uint8)
    luma, blue, red = planes[0], planes[1] - 128, planes[2] - 128
    rgb = np.empty((*luma.shape, 3), np.float32)
    rgb[..., 0] = luma + np.float32(1.402) * red
    rgb[..., 1] = luma - np.float32(0.344136) * blue - np.float32(0.714136) * red
    rgb[..., 2] = luma + np.float32(1.772) * blue
    return np.rint(np.clip(rgb, 0, 255, out=rgb), out=rgb).astype(np.uint8)


def payload_of(image: Image) -> bytes:
    """The payload of an image that ``encode`` made."""
    n = int(image.comment.removeprefix(b"blocks "))
    v = np.concatenate([c.reshape(-1, 64) for c in image.coefficients])[:n]
    out = np.empty(v.shape, np.uint8)
    size = np.abs(v)  # sign and magnitude, but for the first coefficient
    out[:, 1:] = (np.where(v > 0, size >> 1, 127 - (size >> 1)) << 1 | size & 1)[:, 1:]
    half = v[:, 0] >> 1
    out[:, 0] = np.where(half > 0, half, half + 127) << 1 | v[:, 0] & 1
    return out.tobytes()


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes as a JPEG file."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"]
            )

    thin = pick(docs, doc_id="doc_id", text="text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return thin.mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def tensors(media: DataFrame) -> DataFrame:
    """The rows of stored() with the RGB tensor of each file: doc_id, height, width, rgb."""
    bound_batches(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rgb = tensor(read(batch.column(1)[row].as_py()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, 1), pa.array([rgb.shape[0]]), pa.array([rgb.shape[1]]), pa.array([rgb.tobytes()], pa.binary())], ["doc_id", "height", "width", "rgb"]
                )

    return pick(media, doc_id="doc_id", media="media").mapInArrow(run, "doc_id bigint, height bigint, width bigint, rgb binary")


def feature_of(rgb: np.ndarray) -> str:
    """Size, sums of the channels and checksum of a tensor."""
    return f"{rgb.shape[0]}x{rgb.shape[1]}:" + ":".join(str(x) for x in rgb.reshape(-1, 3).sum(axis=0, dtype=np.int64)) + f":{crc32(rgb.tobytes()):08x}"


def kept(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df as Parquet columns at ``path`` (a new folder of the shared one by default), read back. Rows of media or of
    tensors are compressed by zstd, which hardly costs time beside the encoding."""
    path = path or new_folder(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def store(docs: DataFrame, media_path: str, tensor_path: str) -> tuple[DataFrame, DataFrame]:
    """Media and full-resolution RGB tensors of all texts, written to two folders and read back from there."""
    media = kept(stored(docs), "media", media_path)
    return media, kept(tensors(media), "tensors", tensor_path)


def features(media: DataFrame) -> DataFrame:
    """What is read back from the stored files, and a feature of each tensor."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for file in batch.column(2).to_pylist():
                image = read(file)
                payload = payload_of(image)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), crc32(payload[-64:]), len(file), hashlib.sha256(file).hexdigest(), feature_of(tensor(image))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(columns, kinds[2:], strict=True))], names)

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return pick(media, doc_id="doc_id", n_bytes="n_bytes", media="media").mapInArrow(run, schema)


def op10_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the files as they are read back from the shared folder."""
    return features(kept(stored(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media"))
