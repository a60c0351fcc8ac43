"""Media columns: a baseline JPEG codec for luminance tiles, in numpy.

Reading: markers are parsed, byte stuffing and restart markers are resolved, scans are
Huffman-decoded, and the DC coefficients of the luminance blocks give a thumbnail of an
eighth of the size. Entropy-coded segments between restart markers do not depend on each
other, so the segments of all images of a batch are decoded in step: one numpy operation
takes a symbol from each of thousands of segments. AC coefficients are skipped, several
components and sampling factors are understood. Progressive, arithmetic and damaged
files get a status instead of features.

Writing: payload bytes are 8-bit samples. Every sample is one flat 8 x 8 tile, whose only
coefficient is its DC level; with a DC step of 8 the level is the sample minus 128
exactly, so the DC-only thumbnail is the payload, byte for byte, and any JPEG decoder
shows the same samples. A row of tiles is one restart interval. Payloads beyond one
image's size go on in further images of the same stream.

Defined results: a null payload is stored as an empty stream with status ``empty``; an empty
one is a row of zero samples; very long payloads go on in further images; repeated rows are
coded each; empty tables give empty results. Columns of the input that are named like a
result are replaced by it, all others are passed on.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, map_batches, pieces

#: Tiles in a row of an image, and rows of an image (65,535 samples is the format's limit).
TILES = 64
MAX_ROWS = 8191
#: Huffman code lengths for DC categories 0 to 11 (the format's example table).
DC_BITS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_STEP = 8
_EOB = 0x00


def _codes(bits: tuple[int, ...], symbols: bytes) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length) of a canonical Huffman table."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[symbols[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


@functools.lru_cache(256)
def _lut(table: bytes) -> np.ndarray:
    """For each 16-bit window: length << 8 | symbol of the code it starts with; 0 if none."""
    out = np.zeros(1 << 16, np.uint16)
    for symbol, (code, length) in _codes(tuple(table[:16]), table[16:]).items():
        if length <= 16:
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = length << 8 | symbol
    return out


# -- writing


def _segment(marker: int, body: bytes) -> bytes:
    return bytes((0xFF, marker)) + (len(body) + 2).to_bytes(2, "big") + body


@functools.lru_cache(64)
def _header(rows: int) -> bytes:
    quant = bytes([0] + [DC_STEP] * 64)
    frame = bytes([8]) + (rows * 8).to_bytes(2, "big") + (TILES * 8).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    dc = bytes([0x00, *DC_BITS, *range(sum(DC_BITS))])
    ac = bytes([0x10, 1, *[0] * 15, _EOB])  # the end of a block is all there is after a DC level
    return (
        b"\xff\xd8" + _segment(0xDB, quant) + _segment(0xC0, frame) + _segment(0xC4, dc) + _segment(0xC4, ac)
        + _segment(0xDD, TILES.to_bytes(2, "big")) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


_DC_CODE = np.zeros(16, np.int64)
_DC_LEN = np.zeros(16, np.int64)
for _s, (_c, _n) in _codes(DC_BITS, bytes(range(sum(DC_BITS)))).items():
    _DC_CODE[_s], _DC_LEN[_s] = _c, _n


def encode_tiles(payloads: list[bytes]) -> list[bytes]:
    """JPEG streams whose DC thumbnails are the payloads; lengths are multiples of ``TILES``."""
    rows = np.asarray([len(p) // TILES for p in payloads], np.int64)
    if any(len(p) % TILES for p in payloads):
        raise ValueError(f"a payload's length has to be a multiple of {TILES}")
    total = int(rows.sum())
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(total, TILES).astype(np.int32) - 128
    diff = np.diff(samples, axis=1, prepend=0)  # the prediction starts anew in each row
    size = np.abs(diff)
    category = np.zeros_like(size)
    for b in range(8):
        category += size >= 1 << b
    extra = np.where(diff < 0, diff + (1 << category) - 1, diff)
    value = (_DC_CODE[category] << category | extra) << 1  # code, magnitude, and the one-bit end of block
    length = _DC_LEN[category] + category + 1
    at = np.cumsum(length, axis=1) - length
    bits = at[:, -1] + length[:, -1]
    out = np.zeros((total, 2 * TILES + 8), np.uint8)
    every = np.arange(total)
    for j in range(TILES):  # a column of all rows at a time
        word = value[:, j] << (24 - (at[:, j] & 7) - length[:, j])
        byte = at[:, j] >> 3
        out[every, byte] |= (word >> 16).astype(np.uint8)
        out[every, byte + 1] |= (word >> 8 & 0xFF).astype(np.uint8)
        out[every, byte + 2] |= (word & 0xFF).astype(np.uint8)
    full = (bits + 7) >> 3
    rest = bits & 7
    out[every, full - 1] |= np.where(rest > 0, (1 << (8 - rest)) - 1, 0).astype(np.uint8)  # padding is ones
    # Restart markers between the rows of an image, stuffed zeros behind 0xFF.
    first = np.cumsum(rows) - rows
    number = every - np.repeat(first, rows)
    ends_image = (number % MAX_ROWS == MAX_ROWS - 1) | (number == np.repeat(rows, rows) - 1)
    marked = np.flatnonzero(~ends_image)
    out[marked, full[marked]] = 0xFF
    out[marked, full[marked] + 1] = 0xD0 + number[marked] % MAX_ROWS % 8
    column = np.arange(out.shape[1])
    coded = column < full[:, None]
    stuffed = coded & (out == 0xFF)
    copies = (column < (full + np.where(ends_image, 0, 2))[:, None]).astype(np.int64) + stuffed
    flat = np.repeat(out.ravel(), copies.ravel())
    flat[np.cumsum(copies.ravel())[stuffed.ravel()] - 1] = 0
    ends = np.cumsum(copies.sum(axis=1))
    data = flat.tobytes()
    media = []
    for i, n in enumerate(rows.tolist()):
        parts = []
        for r in range(0, n, MAX_ROWS):
            a, b = int(first[i]) + r, int(first[i]) + min(n, r + MAX_ROWS)
            parts += [_header(b - a), data[int(ends[a - 1]) if a else 0 : int(ends[b - 1])], b"\xff\xd9"]
        media.append(b"".join(parts))
    return media


# -- reading


@dataclass
class Image:
    """One image of a stream. ``thumbnail``: a luminance sample for each 8 x 8 block."""

    width: int = 0
    height: int = 0
    thumbnail: np.ndarray | None = None
    status: str = "ok"


@dataclass
class _Scan:
    image: Image
    columns: int = 0  # MCUs in a row
    rows: int = 0
    #: Blocks of an MCU: (component, is luminance, row, column inside the MCU, DC table, AC table)
    blocks: list[tuple[int, bool, int, int, bytes, bytes]] = field(default_factory=list)
    luma: tuple[int, int] = (1, 1)
    shape: tuple[int, int] = (0, 0)
    step: int = 1
    interval: int = 0
    data: list[np.ndarray] = field(default_factory=list)  # entropy-coded segments


class Damaged(ValueError):
    pass


def _parse(data: bytes) -> tuple[list[_Scan], list[Image]]:
    """Images of a stream, one after another, with their first scans."""
    scans, images, at = [], [], 0
    while at < len(data):
        image = Image()
        images.append(image)
        try:
            at = _parse_image(data, at, image, scans)
        except (Damaged, IndexError, KeyError):
            image.status = "damaged"
            break
    return scans, images


def _parse_image(data: bytes, at: int, image: Image, scans: list[_Scan]) -> int:
    if data[at : at + 2] != b"\xff\xd8":
        raise Damaged
    at += 2
    quant: dict[int, int] = {}
    tables: dict[int, bytes] = {}
    parts: list[tuple[int, int, int, int]] = []
    interval = 0
    while True:
        if data[at] != 0xFF:
            raise Damaged
        while data[at] == 0xFF:
            at += 1
        marker = data[at]
        at += 1
        if marker == 0xD9:
            if image.thumbnail is None and image.status == "ok" and not any(s.image is image for s in scans):
                raise Damaged
            return at
        size = int.from_bytes(data[at : at + 2], "big")
        if size < 2 or at + size > len(data):
            raise Damaged
        body = data[at + 2 : at + size]
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = int.from_bytes(body[1 : 2 + wide], "big")  # the DC step is all that counts here
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = body[1 : 17 + n]
                body = body[17 + n :]
        elif marker == 0xDD:
            interval = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            image.height, image.width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            if body[0] != 8 or not image.height or not image.width:
                raise Damaged
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            image.status = "unsupported"
        elif marker == 0xDA:
            segments, at = _segments(data, at)
            if image.status != "ok" or any(s.image is image for s in scans):
                continue  # luminance comes in the first scan
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            by = {p[0]: p for p in parts}
            luma = parts[0]
            scan = _Scan(image, interval=interval, data=segments, step=quant[luma[3]])
            if chosen[0][0] != luma[0]:
                image.status = "unsupported"
                continue
            top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
            up = lambda a, b: -(-a // b)
            scan.shape = (up(up(image.height * luma[2], top_v), 8), up(up(image.width * luma[1], top_h), 8))
            if len(chosen) == 1:  # a scan of one component has a block for each MCU
                scan.rows, scan.columns = scan.shape
                scan.blocks = [(0, True, 0, 0, tables[chosen[0][1] >> 4], tables[0x10 | chosen[0][1] & 15])]
            else:
                scan.rows, scan.columns = up(image.height, 8 * top_v), up(image.width, 8 * top_h)
                scan.luma = (luma[2], luma[1])
                for c, (name, use) in enumerate(chosen):
                    for v in range(by[name][2]):
                        for h in range(by[name][1]):
                            scan.blocks.append((c, name == luma[0], v, h, tables[use >> 4], tables[0x10 | use & 15]))
            scans.append(scan)


def _segments(data: bytes, at: int) -> tuple[list[np.ndarray], int]:
    """Segments between restart markers, without stuffing, and where the next marker is."""
    raw = np.frombuffer(data, np.uint8, offset=at)
    marks = np.flatnonzero(raw == 0xFF)
    marks = marks[marks + 1 < len(raw)]
    after = raw[marks + 1]
    other = np.flatnonzero((after != 0) & (after != 0xFF) & ((after < 0xD0) | (after > 0xD7)))
    if not len(other):
        raise Damaged
    end = int(marks[other[0]])
    marks, after = marks[: other[0]], after[: other[0]]
    keep = np.ones(end, bool)
    keep[marks[after == 0] + 1] = False
    restarts = marks[(after >= 0xD0) & (after <= 0xD7)]
    keep[restarts] = keep[restarts + 1] = False
    new = np.cumsum(keep) - keep
    clean = raw[:end][keep]
    return np.split(clean, new[restarts]) if len(restarts) else [clean], at + end


def _decode_scans(scans: list[_Scan]) -> None:
    """Fills in thumbnails; scans of the same kind are decoded in step."""
    kinds: dict[tuple, list[_Scan]] = {}
    for s in scans:
        kinds.setdefault(tuple(s.blocks), []).append(s)
    for blocks, group in kinds.items():
        _decode_group(list(blocks), group)


def _decode_group(blocks: list, scans: list[_Scan]) -> None:
    pieces_, counts, owner = [], [], []
    for i, s in enumerate(scans):
        total = s.rows * s.columns
        step = s.interval or total
        wanted = -(-total // step)
        got = s.data[:wanted]
        if len(got) < wanted:
            s.image.status = "damaged"
        for k, part in enumerate(got):
            pieces_.append(part)
            counts.append(min(step, total - k * step))
            owner.append(i)
    if not pieces_:
        return
    sizes = np.asarray([len(p) for p in pieces_], np.int64)
    data = np.concatenate([*pieces_, np.full(16, 0xFF, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(data, 8)
    limit = (np.cumsum(sizes)) * 8
    start = limit - sizes * 8
    counts_a = np.asarray(counts, np.int64)
    order = np.argsort(-counts_a, kind="stable")
    at = start[order]
    most = int(counts_a[order[0]])
    active = np.searchsorted(-counts_a[order], -np.arange(most), side="left")  # segments that have an MCU m
    luma = [b for b in blocks if b[1]]
    out = np.zeros((len(order), most, len(luma)), np.int32)
    n_parts = max(b[0] for b in blocks) + 1
    level = np.zeros((n_parts, len(order)), np.int64)
    bad = np.zeros(len(order), bool)
    last = windows.shape[0] - 1

    def peek(places: np.ndarray) -> np.ndarray:
        """57 valid bits or more from each place on, left-aligned."""
        byte = np.minimum(places >> 3, last)
        word = windows[byte].view(">u8")[:, 0].astype(np.uint64)
        return word << (places & 7).astype(np.uint64)

    def code(word: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hit = lut[(word >> np.uint64(48)).astype(np.int64)].astype(np.int64)
        return hit >> 8, hit & 0xFF

    for m in range(most):
        live = slice(0, int(active[m]))
        seen = 0
        for part, is_luma, _, _, dc, ac in blocks:
            word = peek(at[live])
            length, size = code(word, _lut(dc))
            bad[live] |= (length == 0) | (size > 11)
            size = np.minimum(size, 11)
            word = word << length.astype(np.uint64)
            bits = (word >> (np.uint64(63) - size.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
            diff = np.where(bits < (1 << size >> 1), bits - (1 << size) + 1, bits)
            level[part, live] += diff
            if is_luma:
                out[live, m, seen] = level[part, live]
                seen += 1
            word = word << size.astype(np.uint64)
            end_length, end_symbol = code(word, _lut(ac))
            bad[live] |= end_length == 0
            at[live] += length + size + end_length
            # Blocks that do not end here: their AC symbols are skipped one by one.
            open_ = np.flatnonzero(end_symbol != _EOB)
            k = np.ones(len(open_), np.int64)
            symbol = end_symbol[open_]
            while len(open_):
                k += (symbol >> 4) + 1
                at[open_] += symbol & 15
                more = (k < 64) & ~bad[open_]
                open_, k = open_[more], k[more]
                if not len(open_):
                    break
                length, symbol = code(peek(at[open_]), _lut(ac))
                bad[open_] |= length == 0
                at[open_] += length
                more = (symbol != _EOB) & ~bad[open_]
                open_, k, symbol = open_[more], k[more], symbol[more]
            np.minimum(at, data.size * 8, out=at)
    bad |= at > limit[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    owner_a = np.asarray(owner)
    first = np.searchsorted(owner_a, np.arange(len(scans)))
    for i, s in enumerate(scans):
        n = int(np.searchsorted(owner_a, i, side="right")) - int(first[i])
        rows = place[first[i] : first[i] + n]
        if s.image.status != "ok" or bad[rows].any():
            s.image.status = "damaged"
            continue
        step = s.interval or s.rows * s.columns
        mcus = out[rows][:, :step].reshape(-1, len(luma))[: s.rows * s.columns]
        v, h = s.luma
        grid = mcus.reshape(s.rows, s.columns, v, h).transpose(0, 2, 1, 3).reshape(s.rows * v, s.columns * h)
        levels = grid[: s.shape[0], : s.shape[1]] * s.step / 8 + 128
        s.image.thumbnail = np.clip(np.rint(levels), 0, 255).astype(np.uint8)


def read_thumbnails(media: list[bytes | None]) -> list[list[Image]]:
    """The images of each stream, with DC-only luminance thumbnails."""
    scans, out = [], []
    for data in media:
        own, images = _parse(data or b"")
        scans += own
        out.append(images)
    _decode_scans(scans)
    return out


def thumbnail_hashes(image: np.ndarray) -> tuple[int, int]:
    """64-bit average hash and difference hash of a thumbnail."""
    sums = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=sums[1:, 1:])

    def shrink(rows: int, columns: int) -> np.ndarray:
        def cuts(n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
            a = np.arange(parts) * n // parts
            return a, np.maximum(a + 1, np.arange(1, parts + 1) * n // parts)

        (a, b), (c, d) = cuts(image.shape[0], rows), cuts(image.shape[1], columns)
        area = (b - a)[:, None] * (d - c)
        return (sums[b][:, d] - sums[a][:, d] - sums[b][:, c] + sums[a][:, c]) / area

    small, wide = shrink(8, 8), shrink(8, 9)
    pack = lambda bits: int.from_bytes(np.packbits(bits.ravel()).tobytes(), "big")
    return pack(small > small.mean()), pack(wide[:, 1:] > wide[:, :-1])


# -- columns


def _batches(df: DataFrame, column: str, limit: int, schema: str, work):
    results = {f.split()[0].strip("`") for f in schema.split(", ")}
    carried = [c for c in df.columns if c != column and c not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, column, limit):
            made = work(batch.column(column).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *made.values()], names=[*carried, *made])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carried]
    return map_batches(df.select(*carried, column), run, ", ".join([*fields, schema]))


def with_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Replaces a binary column, padded with zero bytes to whole rows of tiles, by its media column."""

    def work(values: list[bytes | None]) -> dict:
        padded = [None if v is None else v + bytes(-len(v) % TILES if v else TILES) for v in values]
        coded = iter(encode_tiles([p for p in padded if p is not None]))
        return {media: pa.array([b"" if p is None else next(coded) for p in padded], pa.binary())}

    return _batches(df, payload, 2 << 20, f"`{media}` binary", work)


def with_features(df: DataFrame, media: str = "media") -> DataFrame:
    """Replaces a media column by what is read from it: ``media_bytes``, ``media_sha256``,
    ``status``, ``width``, ``height`` and ``images`` (of the first image, and how many),
    ``average_hash``, ``difference_hash``, and ``samples``, the thumbnails' samples.
    """
    schema = (
        "media_bytes bigint, media_sha256 string, status string, width int, height int, images int, "
        "average_hash string, difference_hash string, samples binary"
    )

    def work(values: list[bytes | None]) -> dict:
        cols: dict[str, list] = {c.split()[0]: [] for c in schema.split(", ")}
        for data, images in zip(values, read_thumbnails(values), strict=True):
            good = bool(images) and all(i.status == "ok" for i in images)
            hashes = thumbnail_hashes(np.concatenate([i.thumbnail for i in images]) if len({i.width for i in images}) == 1 else images[0].thumbnail) if good else (None, None)
            status = "empty" if not images else next((i.status for i in images if i.status != "ok"), "ok")
            row = (
                len(data or b""), hashlib.sha256(data or b"").hexdigest(), status,
                images[0].width if images else None, images[0].height if images else None, len(images),
                *(None if h is None else f"{h:016x}" for h in hashes), b"".join([i.thumbnail.tobytes() for i in images]) if good else None,
            )
            for c, v in zip(cols, row, strict=True):
                cols[c].append(v)
        kinds = {"media_bytes": pa.int64(), "width": pa.int32(), "height": pa.int32(), "images": pa.int32(), "samples": pa.binary()}
        return {c: pa.array(v, kinds.get(c, pa.string())) for c, v in cols.items()}

    return _batches(df, media, 2 << 20, schema, work)


def op1_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = documents(spark, sf_dir).select(
        "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.encode(text, "UTF-8").alias("payload")
    )
    read = with_features(with_media(docs))
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("samples").cast("long").alias("payload_bytes"),
        F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        F.format_string("jpeg %dx%d images=%d a=%s d=%s", "width", "height", "images", "average_hash", "difference_hash").alias("feature"),
        "status",
    )
