"""Decoders: bytes to image records (see schema.record)."""

from __future__ import annotations

from collections.abc import Callable

from ..options import ReadOptions
from ..schema import ImageError, Status, Unsupported, failure
from .bmp import bmp, dib
from .jpeg import jpeg
from .netpbm import pam, pbm, pfm, pgm, ppm
from .png import png
from .qoi import qoi
from .tga import tga

DECODERS: dict[str, Callable[[bytes, ReadOptions], dict]] = {
    "pbm": pbm, "pgm": pgm, "ppm": ppm, "pfm": pfm, "pam": pam, "bmp": bmp, "dib": dib, "tga": tga, "qoi": qoi, "png": png, "jpeg": jpeg,
}
#: Known by name, but decoded by operating systems only.
SYSTEM_ONLY = ("heic", "jxl", "jp2")


def decode(content: bytes | None, codec: str | None, options: ReadOptions | None = None) -> dict:
    """The record of content. Never raises: bad, foreign or unsupported content gives a record with a status and reason."""
    if content is None:
        return failure(codec, Status.NOT_FOUND, "no content")
    if codec in SYSTEM_ONLY:
        return failure(codec, Status.UNSUPPORTED, "needs the operating system's codec")
    if codec not in DECODERS:
        return failure(codec, Status.ERROR, "unknown extension")
    try:
        return DECODERS[codec](bytes(content), options or ReadOptions())
    except Unsupported as e:
        return failure(codec, Status.UNSUPPORTED, str(e))
    except ImageError as e:
        return failure(codec, Status.ERROR, str(e))
    except MemoryError:
        return failure(codec, Status.NO_MEMORY, "out of memory")
    except Exception as e:  # damaged content shows in many ways
        return failure(codec, Status.ERROR, f"{type(e).__name__}: {e}")
