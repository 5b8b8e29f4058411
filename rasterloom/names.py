"""From a file name to its codec, for code that runs outside column expressions."""

from __future__ import annotations

from .functions.dispatch import SLOTS


def extension_hash(ext: str) -> int:
    h = 2166136261
    for c in ext[:4].encode("latin-1", "replace"):
        h = (h ^ (c | 32)) * 16777619 & 0xFFFFFFFF
    return (h ^ h >> 16) & 255


def codec_of(path: str) -> str | None:
    _, dot, ext = path.rpartition(".")
    return SLOTS.get(extension_hash(ext)) if dot else None
