"""Decoders against encoders and hand-made bytes; nothing here needs Spark."""

import importlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rasterloom.codecs import DECODERS, decode
from rasterloom.codecs.bmp import masked, run_lengths, unpacked
from rasterloom.codecs.jpeg import BASIS, BASIS_BITS, ZIGZAG, coefficients, inverse_dct, to_rgb
from rasterloom.names import codec_of, extension_hash
from rasterloom.options import ReadOptions
from rasterloom.plans import rasters as R
from rasterloom.schema import Alpha, Format, Orientation, Status

RNG = np.random.default_rng(3)
P = importlib.import_module("rasterloom.codecs.png")  # the package's name `png` is the decoder


def px(h, w, c, top=256):
    return RNG.integers(0, top, (h, w, c))


def samples(got, dtype=np.uint8):
    assert got["status"] == 0, got["reason"]
    return np.frombuffer(got["data"], dtype)


@pytest.mark.parametrize("ascii_", [False, True])
@pytest.mark.parametrize("c", [1, 3])
@pytest.mark.parametrize("maxval", [255, 15, 100, 1000, 65535])
def test_pnm(ascii_, c, maxval):
    v = px(5, 7, c, maxval + 1)
    got = decode(R.pnm(v, ascii_, maxval), "pgm" if c == 1 else "ppm")
    top = 255 if maxval < 256 else 65535
    want = v if maxval == top else np.minimum(np.trunc(v.astype(np.float32) * (np.float32(top) / np.float32(maxval))), top)
    assert (samples(got, np.uint8 if top == 255 else ">u2") == want.ravel()).all()
    assert (got["width"], got["height"], got["components"]) == (7, 5, c)


def test_pnm_comments_and_white_space_pixels():
    assert decode(b"P5 # a\n# b\n 2 #c\n1\n255\n\x20\x0a", "pgm")["data"] == b"\x20\x0a"
    assert decode(b"P2\n2 2\n255\n1 2 # c\n3 300", "pgm")["data"] == bytes((1, 2, 3, 255))


@pytest.mark.parametrize("text", [b"1 2 3", b"1 2 3 \n", b"", b"1 2 3 x"])
def test_pnm_text_with_too_few_numbers(text):
    assert decode(b"P2\n2 2\n255\n" + text, "pgm")["status"] == Status.ERROR


@pytest.mark.parametrize("w", [8, 10, 1])
@pytest.mark.parametrize("ascii_", [False, True])
def test_pbm(w, ascii_):
    bits = px(3, w, 1, 2)[:, :, 0]
    got = decode(R.pbm(bits, ascii_), "pbm")
    assert (samples(got) == 255 * (1 - bits.ravel())).all() and got["format"] == Format.BLACKWHITE


def test_pbm_without_spaces_and_with_comment():
    assert decode(b"P1\n3 1\n# x 1 1\n0 11", "pbm")["data"] == bytes((255, 0, 0))


@pytest.mark.parametrize("c", [1, 3, 4])
@pytest.mark.parametrize("little", [False, True])
def test_pfm(c, little):
    v = np.array([-1.0, 0.0, 0.5, 0.999, 1.0, 7.0, np.nan, 0.2, 0.3, 0.4, 0.6, 0.7], np.float32).reshape(1, -1, c)
    got = decode(R.pfm(v, little), "pfm")
    want = [0, 0, 127, 254, 255, 255, 0, 51, 76, 102, 153, 178]
    assert abs(samples(got).astype(int) - want).max() <= 1 and samples(got)[2] == 127
    assert got["alpha_info"] == (Alpha.LAST if c == 4 else Alpha.NONE) and got["top_down"] is False


@pytest.mark.parametrize("kind,c,fmt", [(b"BLACKANDWHITE", 1, Format.BLACKWHITE), (b"GRAYSCALE", 1, Format.GRAY), (b"RGB", 3, Format.RGB), (b"RGB_ALPHA", 4, Format.RGBA), (b"GRAYSCALE_ALPHA", 2, Format.GRAY_ALPHA), (None, 4, Format.RGBA), (None, 3, Format.RGB)])
def test_pam(kind, c, fmt):
    v = px(2, 3, c, 2 if kind == b"BLACKANDWHITE" else 256)
    got = decode(R.pam(v, kind, 1 if kind == b"BLACKANDWHITE" else 255), "pam")
    assert (samples(got) == v.ravel() * (255 if kind == b"BLACKANDWHITE" else 1)).all() and got["format"] == fmt


def test_pam_errors_and_order():
    assert decode(b"P7\nENDHDR\n", "pam")["status"] == Status.ERROR
    assert decode(b"P7\nMAXVAL 255\nTUPLTYPE RGB\nHEIGHT 1\n# c\nWIDTH 1\nENDHDR\nabc", "pam")["data"] == b"abc"
    assert decode(b"P7\nWIDTH 1\nHEIGHT 1\nDEPTH 1\nENDHDR\na", "pam")["status"] == Status.ERROR


@pytest.mark.parametrize("flags,want", [(0, 6), (8, 10), (16, 4), (24, 8)])
def test_tga(flags, want):
    v = px(2, 3, 3)
    got = decode(R.tga(v, flags, bytes(range(9))), "tga")
    assert (samples(got) == v.ravel()).all() and got["orientation"] == want and got["palette"]["count"] == 3
    assert Orientation.DOWN | Orientation.LEFT == 6
    swapped = decode(R.tga(v, flags), "tga", ReadOptions(bgr_to_rgb=True))
    assert (samples(swapped) == v[:, :, ::-1].ravel()).all()


def test_tga_run_lengths_are_unsupported():
    data = bytearray(R.tga(px(2, 2, 3)))
    data[2] = 10
    assert decode(bytes(data), "tga")["status"] == Status.UNSUPPORTED


@pytest.mark.parametrize("c", [3, 4])
@pytest.mark.parametrize("top", [2, 8, 256])
def test_qoi(c, top):
    v = px(9, 11, c, top)
    got = decode(R.qoi(v, 1), "qoi")
    assert (samples(got) == v.ravel()).all() and got["color_space"] == 2


def test_qoi_runs_and_early_end():
    v = np.full((10, 20, 3), 9)
    data = R.qoi(v)
    assert (samples(decode(data, "qoi")) == 9).all()
    short = b"qoif" + struct.pack(">IIBB", 4, 1, 4, 0) + b"\xff\1\2\3\4" + b"\0" * 7 + b"\1"
    assert decode(short, "qoi")["data"] == b"\1\2\3\4" * 4
    luma = b"qoif" + struct.pack(">IIBB", 2, 1, 3, 0) + b"\xa5\x88" + b"\x7f" + b"\0" * 7 + b"\1"
    assert decode(luma, "qoi")["data"] == bytes((5, 5, 5, 6, 6, 6))


PALETTE = RNG.integers(0, 256, (256, 3))


@pytest.mark.parametrize("w", [1, 4, 5, 7, 9])
@pytest.mark.parametrize("bpp", [1, 2, 4, 8])
@pytest.mark.parametrize("header", [12, 40, 64, 108, 124])
def test_bmp_palettes(w, bpp, header):
    index = px(3, w, 1, 1 << bpp)[:, :, 0]
    rows = R.packed_rows(index, bpp) if bpp < 8 else index
    got = decode(R.bmp(rows, w, 3, bpp, palette=PALETTE[: 1 << bpp], header=header), "bmp")
    out = samples(got).reshape(3, -1)
    if bpp == 1:
        assert (out[:, :w] == index * 255).all() and got["row_pad"] == -w % 4
    else:
        assert (out[:, : 3 * w].reshape(3, w, 3) == PALETTE[index]).all() and got["row_pad"] == -3 * w % 4


def test_bmp_odd_depths():
    rows = np.array([[0b10110100, 0, 0, 0]], np.uint8)
    assert unpacked(rows, 3, 3).tolist() == [[5, 5, 0]]
    assert unpacked(rows, 2, 5).tolist() == [[0b10110, 0b10000]]


@pytest.mark.parametrize("w", [1, 2, 3, 4])
def test_bmp_true_colour(w):
    v = px(2, w, 3)
    got = decode(R.bmp(v.reshape(2, -1), w, 2, 24), "bmp")
    assert (samples(got).reshape(2, -1)[:, : 3 * w].reshape(2, w, 3) == v).all() and (got["hres"], got["format"]) == (2835, Format.BGR)
    v = px(2, w, 4)
    plain = decode(R.bmp(v.reshape(2, -1), w, 2, 32), "bmp")
    assert (samples(plain) == v.ravel()).all() and plain["format"] == Format.BGRA
    cmyk = decode(R.bmp(v.reshape(2, -1), w, 2, 32, 11), "bmp")
    assert (samples(cmyk) == v.ravel()).all() and cmyk["format"] == Format.CMYK


def test_bmp_masks():
    word = np.array([0x7FFF, 0x1234, 0x0000, 0x7C00], "<u2")
    got = samples(decode(R.bmp(word.view(np.uint8).reshape(1, -1), 4, 1, 16), "bmp")).reshape(4, 3)
    assert got[0].tolist() == [255] * 3 and got[3].tolist() == [0, 0, 255]
    assert got[1].tolist() == [int(((0x1234 >> s) & 31) * 255 / 31) for s in (0, 5, 10)]
    four = np.array([0x80FF0040], "<u4").view(np.uint8).reshape(1, -1)
    made = R.bmp(four, 1, 1, 32, 6, (0xFF0000, 0xFF00, 0xFF, 0xFF000000))
    assert samples(decode(made, "bmp")).tolist() == [0x40, 0, 255, 0x80]
    assert masked(np.array([5]), 0).tolist() == [0] and masked(np.array([0xF0]), 0xF0).tolist() == [255]


def test_bmp_top_down_and_dib():
    v = px(2, 2, 3)
    data = R.bmp(v.reshape(2, -1), 2, -2, 24)
    assert decode(data, "bmp")["top_down"] is True
    got = decode(data[14:], "dib")
    assert got["status"] == 0 and got["data"] == decode(data, "bmp")["data"]


@pytest.mark.parametrize("bits", [4, 8, 24])
def test_run_lengths(bits):
    index = px(6, 13, 3 if bits == 24 else 1, 16 if bits == 4 else 4)
    index = index if bits == 24 else index[:, :, 0]
    index[2] = index[2, 0]
    assert (run_lengths(R.rle(index, bits), 13, 6, bits) == index.ravel()).all()


def test_run_length_codes():
    # A delta of 1 column and 1 row, a literal run clipped at the row's end, an early end.
    assert run_lengths(bytes((2, 7, 0, 2, 1, 1, 1, 5, 0, 1)), 4, 2, 8).tolist() == [7, 7, 0, 0, 0, 0, 0, 5]
    assert run_lengths(bytes((0, 5, 1, 2, 3, 4, 5, 0, 2, 9, 0, 1)), 3, 2, 8).tolist() == [1, 2, 3, 9, 9, 0]
    assert run_lengths(bytes((3, 0x12, 0, 3, 0x34, 0x50, 0, 0)), 6, 1, 4).tolist() == [1, 2, 1, 3, 4, 5]
    assert run_lengths(b"\5", 2, 1, 8).tolist() == [0, 0]


@pytest.mark.parametrize("kind", [0, 1, 2, 3, 4, None])
@pytest.mark.parametrize("color,c", [(0, 1), (2, 3), (4, 2), (6, 4)])
@pytest.mark.parametrize("depth", [8, 16])
@pytest.mark.parametrize("interlace", [False, True])
def test_png(kind, color, c, depth, interlace):
    v = px(11, 9, c, 1 << depth)
    got = decode(R.png(v, color, depth, kind, interlace), "png")
    assert (samples(got, np.uint8 if depth == 8 else ">u2") == v.ravel()).all() and got["components"] == c
    if depth == 16:
        little = decode(R.png(v, color, depth, kind, interlace), "png", ReadOptions.parse(byteOrder="little"))
        assert (samples(little, "<u2") == v.ravel()).all()


@pytest.mark.parametrize("depth", [1, 2, 4])
@pytest.mark.parametrize("interlace", [False, True])
@pytest.mark.parametrize("w", [1, 3, 8, 13])
def test_png_small_samples(depth, interlace, w):
    v = px(5, w, 1, 1 << depth)
    got = decode(R.png(v, 0, depth, 2, interlace), "png")
    assert (samples(got).reshape(5, -1) == R.packed_rows(v[:, :, 0], depth)).all()
    plte = R.chunk(b"PLTE", PALETTE[: 1 << depth].astype(np.uint8).tobytes())
    got = decode(R.png(v, 3, depth, 1, interlace, plte), "png", ReadOptions(supports_palette=False))
    assert (samples(got).reshape(5, w, 3) == PALETTE[v[:, :, 0]]).all()
    kept = decode(R.png(v, 3, depth, 1, interlace, plte), "png")
    assert kept["palette"]["count"] == 1 << depth and (samples(kept).reshape(5, -1) == R.packed_rows(v[:, :, 0], depth)).all()


@pytest.mark.parametrize("bpp", [1, 3, 4, 8])
@pytest.mark.parametrize("kinds", [[4], [3], [1], [0, 1, 2, 3, 4]])
def test_diagonals_equal_rows(bpp, kinds):
    rng = np.random.default_rng(bpp)
    for h, w in ((1, 1), (1, 30), (30, 1), (17, 40), (40, 17)):
        lines, above = rng.integers(0, 256, (h, w * bpp)).astype(np.uint8), rng.integers(0, 256, w * bpp).astype(np.uint8)
        filters = rng.choice(kinds, h).astype(np.uint8)
        assert (P._by_diagonals(lines, filters, above, bpp) == P._by_rows(lines, filters, above, bpp)).all()


def test_large_png_in_bands(monkeypatch):
    v = RNG.integers(0, 256, (150, 130, 3)).cumsum(0) % 256
    data = R.png(v, 2)
    for band, worth in ((256, 0), (37, 0), (37, 10**9), (256, 180)):
        monkeypatch.setattr(P, "BAND", band)
        monkeypatch.setattr(P, "WORTH", worth)
        assert decode(data, "png")["data"] == v.astype(np.uint8).tobytes()


def test_png_keys():
    v = px(3, 3, 3, 65536)
    v[1, 1] = (300, 44, 45)
    v[0, 0] = (44, 44, 45)  # the low bytes alone are the key's
    key = R.chunk(b"tRNS", struct.pack(">HHH", 300, 44, 45))
    got = samples(decode(R.png(v, 2, 16, extra=key), "png"), ">u2").reshape(3, 3, 4)
    assert (got[:, :, :3] == v).all() and got[1, 1, 3] == 0 and got[0, 0, 3] == 65535
    gray = decode(R.png(px(2, 2, 1), 0, extra=R.chunk(b"tRNS", struct.pack(">H", 5))), "png")
    assert gray["format"] == Format.GRAY_ALPHA and gray["len"] == 4 and gray["trns"]["gray"] == 5


def test_png_metadata():
    import zlib

    extra = R.chunk(b"gAMA", struct.pack(">I", 45455)) + R.chunk(b"cHRM", struct.pack(">8I", *range(8))) + R.chunk(b"pHYs", struct.pack(">IIB", 9, 8, 1))
    extra += R.chunk(b"tIME", struct.pack(">HBBBBB", 2020, 2, 29, 1, 2, 3)) + R.chunk(b"iCCP", b"n\0\0" + zlib.compress(b"profile" * 99)) + R.chunk(b"bKGD", struct.pack(">HHH", 1, 2, 3))
    got = decode(R.png(px(1, 1, 3), 2, extra=extra), "png")
    assert got["gamma"] == 0.45455 and got["chroma"]["blue_y"] == 0.00007 and got["phys"] == {"x": 9, "y": 8, "unit": 1}
    assert got["icc"] == b"profile" * 99 and got["time"]["day"] == 29 and got["background"] == {"red": 1, "green": 2, "blue": 3}


@pytest.mark.parametrize("chunk", [(b"gAMA", b"1"), (b"PLTE", b"1234"), (b"tRNS", b"1"), (b"pHYs", b""), (b"tIME", b"1"), (b"iCCP", b"n\0\1x"), (b"sRGB", b"")])
def test_png_wrong_lengths(chunk):
    assert decode(R.png(px(1, 1, 3), 3 if chunk[0] == b"PLTE" else 2, extra=R.chunk(*chunk)), "png")["status"] == Status.ERROR


def test_png_index_beyond_palette():
    data = R.png(np.full((1, 1, 1), 2), 3, extra=R.chunk(b"PLTE", b"123456"))
    assert decode(data, "png", ReadOptions(supports_palette=False))["status"] == Status.ERROR


def test_zigzag_and_inverse_dct():
    assert ZIGZAG.tolist()[:9] == [0, 1, 8, 16, 9, 2, 3, 10, 17] and sorted(ZIGZAG) == list(range(64))
    blocks = np.zeros((3, 8, 8), np.int16)
    blocks[0, 0, 0], blocks[1, 0, 0], blocks[2] = 80, -2000, RNG.integers(-60, 60, (8, 8))
    got = inverse_dct(blocks)
    assert (got[0] == 138).all() and (got[1] == 0).all()
    c = np.where(np.arange(8) == 0, np.sqrt(0.5), 1)
    basis = c[:, None] * np.cos((2 * np.arange(8) + 1) * np.arange(8)[:, None] * np.pi / 16) / 2
    exact = np.clip(basis.T @ blocks[2].astype(float) @ basis + 128, 0, 255)
    assert abs(got[2] - exact).max() <= 1.01


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (1, 2), (2, 2)])
def test_jpeg(sampling):
    h, v = sampling
    y, cb, cr = RNG.integers(-128, 128, (2 * v, 3 * h)), RNG.integers(-128, 128, (2, 3)), RNG.integers(-128, 128, (2, 3))
    height, width = 16 * v - 3, 24 * h - 5
    got = decode(R.flat_jpeg(y, cb, cr, sampling, (height, width), b"hi"), "jpeg")
    big = lambda p, a, b: p.repeat(a, 0).repeat(b, 1)[:height, :width] + 128
    want = to_rgb(big(y, 8, 8), big(cb, 8 * v, 8 * h), big(cr, 8 * v, 8 * h))
    assert (samples(got).reshape(height, width, 3) == want).all() and got["comments"] == ["hi"]


def coded(seed, size=(16, 24)):
    rng = np.random.default_rng(seed)
    n = (size[0] // 8) * (size[1] // 8)
    planes = [np.where(rng.random((n, 64)) < 0.15, rng.integers(-40, 41, (n, 64)), 0) for _ in range(3)]
    for p in planes:
        p[:, 0] = rng.integers(-100, 100, n)
    planes[0][0, 1:] = 0
    planes[0][0, 63] = -1  # 62 zeros, then the last coefficient: no end of block
    quantisers = [1 + rng.integers(0, 3, 64) for _ in range(3)]
    return planes, quantisers, R.coded_jpeg(planes, quantisers, size)


@pytest.mark.parametrize("seed", range(5))
def test_jpeg_coefficients(seed):
    planes, quantisers, data = coded(seed)
    for (got, _), plane, q in zip(coefficients(data), planes, quantisers, strict=True):
        want = np.zeros_like(got)
        want[:, ZIGZAG] = plane * q
        assert (got == want).all()


@pytest.mark.parametrize("seed", range(5))
def test_jpeg_samples(seed):
    """Against the exact transform and the colour formula, sample by sample."""
    planes, quantisers, data = coded(seed)
    exact = []
    for plane, q in zip(planes, quantisers, strict=True):
        flat = np.zeros((len(plane), 64))
        flat[:, ZIGZAG] = plane * q
        px = np.clip(np.rint(flat @ BASIS / (1 << BASIS_BITS)) + 128, 0, 255)
        exact.append(px.reshape(2, 3, 8, 8).transpose(0, 2, 1, 3).reshape(16, 24))
    got = samples(decode(data, "jpeg")).reshape(16, 24, 3).astype(int)
    assert abs(got - to_rgb(*exact)).max() <= 4
    assert abs(got[:, :, 0] - to_rgb(*exact)[:, :, 0].astype(int)).mean() < 0.7


def test_jpeg_unsupported_and_broken():
    one = np.zeros((1, 1), int)
    data = R.flat_jpeg(one, one, one)
    at = data.index(b"\xff\xc0")
    assert decode(data[:at] + b"\xff\xc2" + data[at + 2 :], "jpeg")["status"] == Status.UNSUPPORTED
    scan = data.index(b"\xff\xda") + 14
    assert decode(data[: scan + 1], "jpeg")["status"] == Status.ERROR and decode(data[:-2], "jpeg")["status"] == Status.OK
    assert decode(data[: at + 4], "jpeg")["status"] == Status.ERROR


def test_profiles_are_bounded():
    bomb = R.chunk(b"iCCP", b"n\0\0" + zlib.compress(bytes(50 << 20)))
    assert decode(R.png(px(1, 1, 3), 2, extra=bomb), "png")["status"] == Status.ERROR
    fair = R.chunk(b"iCCP", b"n\0\0" + zlib.compress(bytes(1000)))
    assert decode(R.png(px(1, 1, 3), 2, extra=fair), "png")["icc"] == bytes(1000)


def test_header_intent_reads_chunks_behind_the_samples():
    data = R.png(px(2, 2, 3), 2)
    late = data[:-12] + R.chunk(b"tIME", bytes([7, 230, 1, 2, 3, 4, 5])) + data[-12:]
    head, whole = decode(late, "png", ReadOptions.parse(openIntent="readonly_header")), decode(late, "png")
    assert head["time"] == whole["time"] and head["time"]["month"] == 1 and head["data"] is None


def test_names():
    assert extension_hash("png") == 0xA9 and extension_hash("JPG") == 0xF7
    assert [codec_of(x) for x in ("a/b.PNG", "a.b/c", "x.jpegx", "x.webp", "x.gif", "none", "x.heic")] == ["png", None, "jpeg", "jpeg", None, None, "heic"]


@pytest.mark.parametrize("codec", [*DECODERS, "heic", None, "other"])
@settings(max_examples=60, deadline=None)
@given(data=st.binary(max_size=200))
def test_nothing_raises(codec, data):
    magic = {"pbm": b"P4", "pgm": b"P5", "ppm": b"P6", "pfm": b"PF", "pam": b"P7", "bmp": b"BM", "qoi": b"qoif", "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff"}.get(codec, b"")
    for content in (data, magic + data, None):
        assert decode(content, codec, ReadOptions(max_pixels=10_000))["status"] is not None


@pytest.mark.parametrize("codec", ["png", "qoi", "bmp", "jpeg", "pgm", "pam", "pfm", "tga"])
def test_every_truncation_has_a_status(codec):
    v = px(4, 4, 3)
    one = np.zeros((1, 1), int)
    made = {"png": lambda: R.png(v, 2), "qoi": lambda: R.qoi(v), "bmp": lambda: R.bmp(v.reshape(4, -1), 4, 4, 24), "jpeg": lambda: R.flat_jpeg(one, one, one), "pgm": lambda: R.pnm(v[:, :, :1]), "pam": lambda: R.pam(v, b"RGB"), "pfm": lambda: R.pfm(v / 255), "tga": lambda: R.tga(v)}[codec]()
    for k in range(len(made)):
        got = decode(made[:k], codec)
        assert got["status"] in (0, -1, -2) and (got["status"] == 0) == (got["reason"] is None)


def test_header_only_and_limits():
    v = px(4, 6, 3)
    for codec, data in (("png", R.png(v, 2)), ("qoi", R.qoi(v)), ("bmp", R.bmp(v.reshape(4, -1), 6, 4, 24)), ("ppm", R.pnm(v)), ("tga", R.tga(v)), ("pfm", R.pfm(v / 255)), ("pam", R.pam(v, b"RGB"))):
        head, whole = decode(data, codec, ReadOptions.parse(openIntent="readonly_header")), decode(data, codec)
        assert head["data"] is None and all(head[k] == whole[k] for k in head if k not in ("data", "len"))
        assert decode(data, codec, ReadOptions(max_pixels=23))["status"] == Status.ERROR


def test_options():
    simple = ReadOptions.parse(preset="simple")
    assert not simple.supports_palette and simple.byte_order == 0
    assert ReadOptions.parse(ROWPAD="4", bgrToRgb="true").bgr_to_rgb
    for bad in ({"nope": 1}, {"preset": "x"}, {"openIntent": "write"}):
        with pytest.raises(ValueError):
            ReadOptions.parse(**bad)
