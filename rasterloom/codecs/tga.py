"""TGA: header, colour map and pixels as they stand in the file."""

from __future__ import annotations

import struct

import numpy as np

from ..options import ReadOptions
from ..schema import Alpha, FileFormat, Format, ImageError, Orientation, Unsupported
from .bmp import Head, whole

_COMPONENTS = {8: 1, 15: 2, 16: 2, 24: 3, 32: 4}
_FORMATS = {1: Format.RGB, 2: Format.RGB, 9: Format.RGB, 10: Format.RGB, 3: Format.BLACKWHITE, 11: Format.BLACKWHITE}


def tga(data: bytes, options: ReadOptions) -> dict:
    return whole("tga", tga_head(data, options), data, options)


def tga_head(data: bytes, options: ReadOptions) -> Head:
    if len(data) < 18:
        raise ImageError("the header breaks off")
    id_size, mapped, kind, _, map_count, map_bits, _, _, width, height, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    comps = _COMPONENTS.get(depth)
    if not width or not height or comps is None or kind not in _FORMATS:
        raise ImageError("type, depth or size out of range")
    if width * height > options.max_pixels:
        raise ImageError("more pixels than maxPixels")
    side = Orientation.RIGHT if flags & 8 else Orientation.LEFT
    up = Orientation.UP if flags & 16 else Orientation.DOWN
    at = 18 + id_size
    palette = None
    if mapped:
        size = map_count * ((map_bits + 7) // 8)
        palette = {"bytes": data[at : at + size], "len": size, "count": map_count}
        at += size
    fields = {
        "format": _FORMATS[kind], "file_format": FileFormat.TGA, "width": width, "height": height, "bytes_per_pixel": comps, "bits_per_pixel": 8 * comps, "bits_per_component": 8, "components": comps,
        "alpha_info": Alpha.NONE, "orientation": int(side) | int(up), "palette": palette, "top_down": bool(flags & 16),
    }

    def raster(raw: np.ndarray) -> np.ndarray:
        if kind > 8:
            raise Unsupported("run-length coded TGA")
        raw = raw[:, : width * height * comps]
        if raw.shape[1] < width * height * comps:
            raise ImageError("pixels are missing")
        return raw.reshape(len(raw), -1, 3)[:, :, ::-1].reshape(len(raw), -1) if options.bgr_to_rgb and comps == 3 else raw

    return fields, at, at, raster
