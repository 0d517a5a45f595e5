"""Media columns: payloads as PNG images in a binary column, and perceptual hashes of what is read back.

A payload of a multiple of 192 bytes becomes an 8-bit RGB image 64 pixels wide (192 bytes a
line). The writer makes the three needed chunks (IHDR, IDAT, IEND), each with its CRC-32, and
gives each line the filter (none, sub or up) of least absolute sum. The reader tests the
signature, chunk lengths and checksums, inflates, and undoes all five filters of the format.
The hash is that of the low frequencies of the luma's cosine transform.
"""

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: PNG: signature; bytes a pixel, pixels a line, and so bytes a line, of the images written here. Fixed values.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS, WIDTH = 3, 64
LINE = CHANNELS * WIDTH
LEVEL = 4
SIDE, LOW = 32, 8


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def filtered(lines: np.ndarray) -> np.ndarray:
    """Lines with their filter byte in front: none, sub or up, whichever has the least sum of absolute (signed) values."""
    sub = lines.copy()
    sub[:, CHANNELS:] -= lines[:, :-CHANNELS]
    up = lines.copy()
    up[1:] -= lines[:-1]
    options = np.stack([lines, sub, up])
    cost = np.abs(options.view(np.int8).astype(np.int16)).sum(axis=2)
    best = cost.argmin(axis=0)
    out = np.empty((len(lines), LINE + 1), np.uint8)
    out[:, 0] = best
    out[:, 1:] = options[best, np.arange(len(lines))]
    return out


def encode_png(payload: bytes) -> bytes:
    """The payload, a positive multiple of LINE bytes, as a PNG image."""
    if not payload or len(payload) % LINE:
        raise ValueError(f"the payload's length must be a positive multiple of {LINE}")
    lines = np.frombuffer(payload, np.uint8).reshape(-1, LINE)
    header = struct.pack(">IIBBBBB", WIDTH, len(lines), 8, 2, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(filtered(lines).tobytes(), LEVEL)) + chunk(b"IEND", b"")


def chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, body) of each chunk up to IEND; raises ValueError where the file is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(media):
        (size,) = struct.unpack_from(">I", media, at)
        kind, body, tail = media[at + 4 : at + 8], media[at + 8 : at + 8 + size], media[at + 8 + size : at + 12 + size]
        if len(tail) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", tail)[0]:
            raise ValueError(f"chunk {kind!r} at {at} is damaged")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise ValueError("the file ends before its IEND chunk")


def paeth(left: np.ndarray, above: np.ndarray, corner: np.ndarray) -> np.ndarray:
    guess = left + above - corner
    a, b, c = np.abs(guess - left), np.abs(guess - above), np.abs(guess - corner)
    return np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))


def unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Undo the line filters. Lines of kind sub are summed along themselves all at once, runs of kind up along their columns."""
    out = lines.copy()
    subs = np.flatnonzero(kinds == 1)
    if len(subs):
        out[subs] = np.cumsum(out[subs].reshape(len(subs), -1, step), axis=1, dtype=np.uint8).reshape(len(subs), -1)
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for first, last in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        kind = kinds[first]
        if kind == 2:
            top = max(first - 1, 0)
            out[top:last] = np.cumsum(out[top:last], axis=0, dtype=np.uint8)
        elif kind in (3, 4):
            for line in range(first, last):
                above = out[line - 1].astype(np.int32) if line else np.zeros(out.shape[1], np.int32)
                left, corner = np.zeros(step, np.int32), np.zeros(step, np.int32)
                for x in range(0, out.shape[1], step):
                    up = above[x : x + step]
                    left = (out[line, x : x + step] + ((left + up) // 2 if kind == 3 else paeth(left, up, corner))) & 255
                    out[line, x : x + step], corner = left, up
        elif kind > 4:
            raise ValueError(f"unknown line filter {kind}")
    return out


def decode_png(media: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit grey, RGB or RGBA image without interlacing."""
    header, data = None, []
    for kind, body in chunks(media):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
    if header is None or header[2] != 8 or header[3] not in (0, 2, 6) or header[6]:
        raise ValueError("this kind of PNG isn't read here")
    width, height, step = header[0], header[1], {0: 1, 2: 3, 6: 4}[header[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(raw) != height * (width * step + 1):
        raise ValueError("the image has another size than its header says")
    lines = raw.reshape(height, -1)
    return unfilter(lines[:, 0], lines[:, 1:], step).reshape(height, width, step)


def cosine_basis(side: int = SIDE, low: int = LOW) -> np.ndarray:
    k, x = np.arange(low)[:, None], np.arange(side)[None, :]
    return np.cos(np.pi * (2 * x + 1) * k / (2 * side))


_BASIS = cosine_basis()


def cosine_hash(samples: np.ndarray) -> bytes:
    """64 bits: which of the LOW x LOW lowest frequencies of the luma, shrunk to SIDE x SIDE, exceed their median (the constant one left out of it)."""
    luma = samples[..., :3].mean(axis=2) if samples.shape[2] >= 3 else samples[..., 0].astype(float)
    for axis in (0, 1):
        edges = np.linspace(0, luma.shape[axis], SIDE + 1)
        first = np.minimum(edges[:-1].astype(int), luma.shape[axis] - 1)
        last = np.maximum(np.ceil(edges[1:]).astype(int), first + 1)
        sums = np.concatenate([np.zeros_like(luma.take([0], axis)), np.cumsum(luma, axis=axis)], axis=axis)
        width = (last - first).reshape((-1, 1) if axis == 0 else (1, -1))
        luma = (sums.take(last, axis) - sums.take(first, axis)) / width
    low = np.round(_BASIS @ luma @ _BASIS.T, 6)
    return np.packbits(low.ravel() > np.median(low.ravel()[1:])).tobytes()


def encode_series(payloads: pd.Series) -> pd.Series:
    return payloads.map(encode_png, na_action="ignore")


def read_back(media: bytes | None) -> tuple[bytes | None, bytes | None]:
    if media is None:
        return None, None
    samples = decode_png(media)
    return samples.tobytes(), cosine_hash(samples)


def read_series(media: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([read_back(x) for x in media], columns=["payload", "hash"])


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none), filled with spaces to a positive multiple of LINE bytes."""
    text = F.coalesce(text, F.lit(""))
    lines = F.greatest(F.lit(1), F.ceil(F.octet_length(text) / LINE))
    return F.concat(text, F.repeat(F.lit(" "), (lines * LINE - F.octet_length(text)).cast("int"))).cast("binary")


def media_columns(documents: DataFrame, text: str = "text") -> DataFrame:
    """Replace the text by media (the PNG, binary), payload (read back from it), hash (8 bytes). Other columns stay; columns of these names are replaced.

    Null and empty texts are images of one line of spaces. Equal texts give equal media and hashes.
    """
    png_of, read_png = F.pandas_udf(encode_series, "binary"), F.pandas_udf(read_series, "payload binary, hash binary")
    kept = [F.col(f"`{name}`") for name in documents.columns if name not in (text, "media", "payload", "hash")]
    stored = documents.select(*kept, png_of(payload_of(F.col(text))).alias("media"))
    return stored.withColumn("__read", read_png("media")).select(*kept, "media", "__read.payload", "__read.hash")


def media_report(documents: DataFrame) -> DataFrame:
    sized = documents.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    payload = F.col("payload")
    return media_columns(sized).select(
        "doc_id", "n_bytes", F.length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -16, 16)).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("hash")).alias("feature"),
    )
