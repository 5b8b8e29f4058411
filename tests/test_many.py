"""Files decoded together against the same files decoded one by one; nothing here needs Spark."""

import struct
import zlib

import numpy as np
import pytest
from rasterloom.codecs import decode
from rasterloom.codecs import many
from rasterloom.codecs.many import decode_many
from rasterloom.options import ReadOptions
from rasterloom.plans import rasters as R
from rasterloom.plans.queries import _coded

RNG = np.random.default_rng(5)


def px(h, w, c, top=256):
    return RNG.integers(0, top, (h, w, c))


def chunks(k):
    extra = R.chunk(b"gAMA", struct.pack(">I", 7 * k)) + R.chunk(b"cHRM", struct.pack(">8I", *range(k, k + 8))) + R.chunk(b"sRGB", bytes([k % 4])) + R.chunk(b"iCCP", b"n\0\0" + zlib.compress(bytes([k]) * 40))
    return extra + R.chunk(b"pHYs", struct.pack(">IIB", k, 3, 1)) + R.chunk(b"tIME", struct.pack(">HBBBBB", 2000 + k, 1, 2, 3, 4, 5))


def flat(k):
    y, cb, cr = RNG.integers(-100, 100, (4, 4)), RNG.integers(-60, 60, (2, 2)), RNG.integers(-60, 60, (2, 2))
    return R.flat_jpeg(y, cb, cr, sampling=(2, 2), size=(20, 30))


MADE = {
    "pgm": [lambda k: R.pnm(px(3, 4, 1)), lambda k: R.pnm(px(3, 4, 1), ascii_=True), lambda k: R.pnm(px(2, 3, 1, 1000), maxval=1000), lambda k: b"P2 2 1 25" + (b"5" if k % 2 else b"") + b" 7 9"],
    "ppm": [lambda k: R.pnm(px(1, k % 5 + 1, 3)), lambda k: R.pnm(px(1, k % 3 + 1, 3), ascii_=True), lambda k: R.pnm(px(2, 2, 3, 100), maxval=99, ascii_=True) + b" #x"],
    "pbm": [lambda k: R.pbm(px(3, 9, 1, 2)[:, :, 0]), lambda k: R.pbm(px(3, 9, 1, 2)[:, :, 0], ascii_=True)],
    "pfm": [lambda k: R.pfm(px(2, 3, 3) / 200), lambda k: R.pfm(px(2, 3, 1) / 200, little=False)],
    "pam": [lambda k: R.pam(px(2, 3, 3), b"RGB"), lambda k: R.pam(px(2, 3, 4, 900), b"RGB_ALPHA", 900)],
    "tga": [lambda k: R.tga(px(2, 3, 3)), lambda k: R.tga(px(1, 2, 1), palette=bytes(range(k % 4 * 3)))],
    "bmp": [
        lambda k: R.bmp(px(3, 15, 1)[:, :, 0], 5, 3, 24), lambda k: R.bmp(px(3, 10, 1)[:, :, 0], 5, 3, 16), lambda k: R.bmp(px(3, 10, 1)[:, :, 0], 5, 3, 16, 3, (0xF800, 0x7E0, 0x1F)),
        lambda k: R.bmp(px(2, 8, 1)[:, :, 0], 2, 2, 32, 3, (0xFF0000, 0xFF00, 0xFF, 0xFF000000), header=124), lambda k: R.bmp(px(2, 8, 1)[:, :, 0], 8, 2, 8, palette=px(1, 256, 3)[0] if k % 2 else np.zeros((256, 3))),
        lambda k: R.bmp(R.rle(px(2, 5, 3, 3), 24), 5, 2, 24, 4), lambda k: R.bmp(R.rle(px(2, 8, 1, 4)[:, :, 0], 8), 8, 2, 8, 1, palette=np.arange(768).reshape(256, 3) % 256),
    ],
    "dib": [lambda k: R.bmp(px(3, 15, 1)[:, :, 0], 5, 3, 24)[14:]],
    "qoi": [lambda k: R.qoi(px(2, k % 4 + 3, 3)), lambda k: R.qoi(px(3, 5, 3, 6) * 2), lambda k: R.qoi(px(3, 5, 4, 9) * 28), lambda k: R.qoi(px(1, 100, 1, 2).repeat(3, 2) // 2 * 9), lambda k: R.qoi(px(2, 9, 3))[: 20 + k % 9]],
    "png": [
        lambda k: R.png(px(2, 5, 3), 2, extra=chunks(k)), lambda k: R.png(px(3, 5, 1), 0, kind=k % 5), lambda k: R.png(px(6, 4, 4), 6), lambda k: R.png(px(3, 5, 1, 60000), 0, 16, kind=4), lambda k: R.png(px(3, 5, 1), 0, interlace=True),
        lambda k: R.png(px(3, 5, 1, 4), 3, 2, extra=R.chunk(b"PLTE", bytes(range(12))) + R.chunk(b"bKGD", bytes([k % 4]))), lambda k: R.png(px(3, 5, 3, 2), 2, extra=R.chunk(b"tRNS", struct.pack(">HHH", 1, 1, 0)) + R.chunk(b"bKGD", struct.pack(">HHH", k, 2, 3))),
        lambda k: R.png(px(1, 2, 1), 0, extra=R.chunk(b"tRNS", struct.pack(">H", k)) + R.chunk(b"bKGD", struct.pack(">H", k))), lambda k: R.png(px(2, 5, 1, 5), 3, extra=R.chunk(b"PLTE", bytes(12)) + R.chunk(b"tRNS", b"\1\2")),
    ],
    "jpeg": [flat, lambda k: _coded(RNG.integers(0, 256, 64)), lambda k: R.flat_jpeg(*[RNG.integers(-9, 9, (1, 1))] * 3, comment=b"c" * (k % 3))],
}
OPTIONS = [{}, {"preset": "simple"}, {"openIntent": "readonly_header"}, {"bgrToRgb": "true", "supportsPalette": "false", "byteOrder": "little"}]


def damaged(data, k):
    """Most files as they are, others cut or with another byte."""
    if k % 7 == 3:
        return data[: RNG.integers(0, len(data))]
    if k % 7 == 5:
        at = RNG.integers(0, len(data))
        return data[:at] + bytes([RNG.integers(0, 256)]) + data[at + 1 :]
    return data


@pytest.mark.parametrize("options", OPTIONS, ids=str)
@pytest.mark.parametrize("codec", sorted(MADE))
def test_together_as_alone(codec, options, monkeypatch):
    monkeypatch.setattr(many, "MISSES", 10_000)
    options = ReadOptions.parse(**options)
    files = [make(k) for make in MADE[codec] for k in range(40)]
    files += [damaged(f, k) for f in files for k in (3, 5)] + [b"", None, b"no"]
    codecs = [codec] * len(files) + ["heic", None]
    files += [b"x", b"y"]
    got = {}
    for places, shared, own in decode_many(files, codecs, options):
        for j, k in enumerate(places):
            assert k not in got
            got[k] = shared | {n: bytes(v[j]) if n == "data" else v[j] for n, v in own.items()}
    assert sorted(got) == list(range(len(files)))
    for k, data in enumerate(files):
        want = decode(data, codecs[k], options)
        if "len" in want and want["len"] and not got[k]["status"]:
            assert got[k]["len"] == want["len"]
        assert got[k] == want, (codec, k)


@pytest.mark.parametrize("codec", sorted(MADE))
def test_most_are_decoded_together(codec):
    """Files of one layout take few groups, and none of them the slow way."""
    for make in MADE[codec][:1]:
        files = [make(5 * k % 50) for k in range(100)]
        groups = list(decode_many(files, [codec] * 100))
        assert len(groups) < 10
