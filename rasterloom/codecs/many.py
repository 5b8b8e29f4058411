"""Small files by the thousand: those that are equal up to their pixels are decoded together, in the same numpy code."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence

import numpy as np

from ..options import ReadOptions
from . import decode
from .bmp import bmp_head, dib_head
from .jpeg import head_size, jpeg_many
from .netpbm import pam_head, pbm_head, pfm_head, pgm_head, ppm_head, samples_of_many, text_size
from .png import Layout, png_many
from .qoi import HEAD, pixels_of_many
from .tga import tga_head

#: Places of files, the record that they share, and the fields in which they differ, one value each (data: bytes, or an array
#: with a row each).
Group = tuple[Sequence[int], dict, dict[str, Sequence]]
#: Pixels of the largest image that is decoded with others, and of all images that are decoded at once.
SMALL, TOGETHER = 1 << 14, 1 << 17
#: Groups of fewer than FEW files that may be met before what is left is decoded file by file.
FEW, MISSES = 8, 32

_HEADS = {"pbm": pbm_head, "pgm": pgm_head, "ppm": ppm_head, "pfm": pfm_head, "pam": pam_head, "bmp": bmp_head, "dib": dib_head, "tga": tga_head}


def decode_many(files: Sequence[bytes | None], codecs: Sequence[str | None], options: ReadOptions | None = None) -> Iterator[Group]:
    """The records of all files, each once, in any order. They are those of decode: whatever can't be decoded together is left
    to it, as is a group in which a file fails."""
    options = options or ReadOptions()
    by_codec: dict[str | None, list[int]] = defaultdict(list)
    for k, codec in enumerate(codecs):
        by_codec[codec].append(k)
    for codec, places in by_codec.items():
        alone = places
        if codec in _HEADS or codec in ("qoi", "png", "jpeg"):
            found = [k for k in places if files[k]]
            alone = [k for k in places if not files[k]]
            yield from _split(files, found, codec, options, alone, {"qoi": _qoi, "png": _png, "jpeg": _jpeg}.get(codec, _headed))
        for k in alone:
            yield [k], decode(files[k], codec, options), {}


def _split(files, places: list[int], codec: str, options: ReadOptions, alone: list[int], together: Callable) -> Iterator[Group]:
    """Groups of files like the first one that is left, until none is. alone gets what isn't decoded together."""
    misses = 0
    while places and misses < MISSES:
        first = decode(files[places[0]], codec, options)
        if first["status"] or first["width"] * first["height"] > SMALL:
            # Of those that fail each has its own reason; large images take longer than the calls they need.
            yield places[:1], first, {}
            places = places[1:]
            misses += 1
            continue
        members, made = together(files, places, codec, options, first)
        misses += len(members) < FEW
        step = max(1, TOGETHER // (first["width"] * first["height"]))
        for i in range(0, len(members), step):
            part = members[i : i + step]
            try:
                done, own = made(part)
            except Exception:  # damage in a file: each shows its own
                done, own = [], {}
            if done:
                yield done, first, own
            if len(done) < len(part):
                taken = set(done)
                alone.extend(k for k in part if k not in taken)
        taken = set(members)
        places = [k for k in places if k not in taken]
    alone.extend(places)


def _headed(files, places, codec, options, first):
    """Formats with a header and then samples at fixed places, or numbers as text."""
    data = files[places[0]]
    _, same, at, raster = _HEADS[codec](data, options)
    start, text = data[:same], data[:2] in (b"P2", b"P3")
    members = [k for k in places if files[k].startswith(start)]
    if data[:2] in (b"P1", b"P2", b"P3"):
        members = [k for k in members if not files[k][same : same + 1].isdigit()]
    if same > len(data) or codec == "pfm" and not start[-1:].isspace():
        members = places[:1]
    if not text:
        members = [k for k in members if len(files[k]) == len(data)]

    def made(part):
        if options.header_only:
            return part, {}
        if text:
            return part, {"data": samples_of_many([files[k][at:] for k in part], *text_size(data))}
        return part, {"data": raster(np.frombuffer(b"".join(files[k] for k in part), np.uint8).reshape(len(part), -1)[:, at:])}

    return members, made


def _qoi(files, places, codec, options, first):
    start = files[places[0]][:HEAD]
    members = [k for k in places if files[k].startswith(start) and len(files[k]) >= 22]
    return members, lambda part: (part, {} if options.header_only else {"data": pixels_of_many([files[k] for k in part], first["width"] * first["height"], first["components"])})


def _png(files, places, codec, options, first):
    layout = Layout(files[places[0]])
    members = [k for k, like in zip(places, layout.shared([files[k] for k in places]).tolist(), strict=True) if like]

    def made(part):
        found, own = png_many([files[k] for k in part], layout, first, options)
        return [part[j] for j in found], own

    return members, made


def _jpeg(files, places, codec, options, first):
    start = files[places[0]][: head_size(files[places[0]], options)]
    members = [k for k in places if files[k].startswith(start)]

    def made(part):
        if options.header_only:
            return part, {}  # the whole file is the head
        sound, rows = jpeg_many([files[k] for k in part], options)
        return [k for k, s in zip(part, sound.tolist(), strict=True) if s], {"data": rows}

    return members, made
