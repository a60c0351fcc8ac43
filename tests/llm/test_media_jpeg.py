import hashlib
import random
import zlib

import numpy as np
import pytest

from gradus.llm.media_jpeg import DC_BITS, _codes, _segment, encode_tiles, op1_media_jpeg, read_thumbnails, thumbnail_hashes, with_features, with_media

AC_BITS = (0, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3)
AC_SYMBOLS = [0x00, 0xF0, 0x01, 0x11, 0x02, 0x31, 0x23, 0x05, 0x71, 0x12, *range(0x81, 0x89), *range(0x91, 0x99), *range(0xA1, 0xA9), *range(0xB1, 0xB5), 0x03, 0x04]


def plain_jpeg(rng, width, height, factors, interval):
    """A JPEG of random coefficients, written bit by bit; also its luminance DC levels."""
    top_h, top_v = max(h for h, _ in factors), max(v for _, v in factors)
    columns, rows = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    if len(factors) == 1:
        columns, rows = -(-width // 8), -(-height // 8)
    dc, ac = _codes(DC_BITS, bytes(range(12))), _codes(AC_BITS, bytes(AC_SYMBOLS))
    bits, parts, level = [], [], [0] * len(factors)
    luma = np.zeros((rows * factors[0][1] if len(factors) > 1 else rows, columns * factors[0][0] if len(factors) > 1 else columns), int)

    def put(value, n):
        bits.extend(value >> (n - 1 - i) & 1 for i in range(n))

    def flush():
        bits.extend([1] * (-len(bits) % 8))
        parts.append(bytes(np.packbits(bits)).replace(b"\xff", b"\xff\x00"))
        bits.clear()

    for mcu in range(rows * columns):
        if interval and mcu and mcu % interval == 0:
            flush()
            parts.append(bytes([0xFF, 0xD0 + (mcu // interval - 1) % 8]))
            level = [0] * len(factors)
        for c, (h, v) in enumerate(factors if len(factors) > 1 else [(1, 1)]):
            for y in range(v):
                for x in range(h):
                    new = rng.randrange(-120, 120)
                    d, level[c] = new - level[c], new
                    size = abs(d).bit_length()
                    put(*dc[size])
                    put(d if d > 0 else d + (1 << size) - 1, size)
                    if c == 0:
                        luma[mcu // columns * v + y, mcu % columns * h + x] = new
                    k = 1
                    while k < 64 and rng.random() < 0.8:
                        s = rng.choice([s for s in AC_SYMBOLS if s and k + (s >> 4) < 64] or [0])
                        if not s:
                            break
                        put(*ac[s])
                        put(rng.getrandbits(s & 15) if s & 15 else 0, s & 15)
                        k += (s >> 4) + 1
                    if k < 64:
                        put(*ac[0])
    flush()
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)])
    frame += b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors))
    scan = bytes([len(factors)]) + b"".join(bytes([i + 1, 0]) for i in range(len(factors))) + bytes([0, 63, 0])
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0") + _segment(0xDB, bytes([0] + [8] * 64)) + _segment(0xC0, frame)
    out += _segment(0xC4, bytes([0, *DC_BITS, *range(12)]) + bytes([0x10, *AC_BITS, *AC_SYMBOLS]))
    out += (_segment(0xDD, interval.to_bytes(2, "big")) if interval else b"") + _segment(0xDA, scan) + b"".join(parts) + b"\xff\xd9"
    return out, luma


@pytest.mark.parametrize("factors", [[(1, 1)], [(2, 2)], [(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
@pytest.mark.parametrize("interval", [0, 1, 3])
def test_reads_colour_and_ac_coefficients(factors, interval):
    rng = random.Random(len(factors) * 10 + interval)
    made = [plain_jpeg(rng, w, h, factors, interval) for w, h in ((1, 1), (70, 33), (16, 200))]
    for (data, luma), [image], (w, h) in zip(made, read_thumbnails([m[0] for m in made]), ((1, 1), (70, 33), (16, 200))):
        assert (image.status, image.width, image.height) == ("ok", w, h)
        rows, columns = -(-h // 8), -(-w // 8)
        assert (image.thumbnail == np.clip(luma[:rows, :columns] + 128, 0, 255)).all()


def test_round_trip_and_damage():
    rng = np.random.default_rng(1)
    payloads = [bytes(64), bytes(range(256)), b"\xff\x00" * 640, rng.bytes(64 * 300), rng.bytes(64 * 8200)]
    media = encode_tiles(payloads)
    read = read_thumbnails(media)
    assert [b"".join(i.thumbnail.tobytes() for i in images) for images in read] == payloads
    assert [len(images) for images in read] == [1, 1, 1, 1, 2]
    cut = media[3][:-500]
    for bad in (cut, cut + b"\xff\xd9", media[3][:40], b"nothing", media[1].replace(b"\xff\xc0", b"\xff\xc2")):
        assert [i.status for i in read_thumbnails([bad])[0]][-1] in ("damaged", "unsupported")
    with pytest.raises(ValueError):
        encode_tiles([b"abc"])


def test_hashes_see_structure():
    ramp = np.tile(np.arange(64, dtype=np.uint8), (16, 1))
    a, d = thumbnail_hashes(ramp)
    assert a == int("0f" * 8, 16) and d == (1 << 64) - 1
    assert thumbnail_hashes(ramp + 3) == (a, d)


def test_query(spark, sf_dir):
    want = {}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = (d.text or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        want[d.doc_id] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    rows = op1_media_jpeg(spark, sf_dir).collect()
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows} == want
    assert all(r.status == "ok" and r.feature.startswith("jpeg 512x") and r.media_bytes > 0 for r in rows)


def test_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x", 0, "a", "m", 7.0), (2, b"", "y", 0, "b", "m", 7.0), (2, b"ab", "z", 0, "c", "m", 7.0)]
    schema = "doc_id bigint, payload binary, other string, status int, width string, media string, samples double"
    df = spark.createDataFrame(rows, schema)
    names = with_features(with_media(df)).columns
    assert len(set(names)) == len(names) and names[:2] == ["doc_id", "other"]
    got = with_features(with_media(df)).collect()
    assert [(r.doc_id, r.status, r.samples and len(r.samples), r.other) for r in got] == [
        (1, "empty", None, "x"), (2, "ok", 64, "y"), (2, "ok", 64, "z")]
    assert with_features(with_media(df.limit(0))).collect() == []
