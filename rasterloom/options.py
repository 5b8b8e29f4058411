"""Read options."""

from __future__ import annotations

from dataclasses import dataclass, replace

from .schema import ByteOrder

INTENTS = ("readonly", "readonly_size", "readonly_header", "readwrite")


@dataclass(frozen=True)
class ReadOptions:
    """byteOrder: of 16-bit PNG samples (any and big keep the file's order). supportsPalette: False expands palette
    images. bgrToRgb: swaps bytes 0 and 2 of 3-byte TGA pixels. rowPad and the supported* lists are accepted and have no
    effect. openIntent: readonly_size and readonly_header leave samples undecoded. maxPixels: larger images fail."""

    byte_order: ByteOrder = ByteOrder.ANY
    supports_palette: bool = True
    bgr_to_rgb: bool = False
    row_pad: int = 0
    open_intent: str = "readonly"
    max_pixels: int = 400_000_000

    @property
    def header_only(self) -> bool:
        return self.open_intent in ("readonly_size", "readonly_header")

    @classmethod
    def parse(cls, **options: object) -> ReadOptions:
        """From reader options, by name without regard to case; preset="simple" sets the combination of that name."""
        out = cls()
        given = {k.lower(): v for k, v in options.items()}
        if (preset := given.pop("preset", None)) is not None:
            if str(preset).lower() != "simple":
                raise ValueError(f"unknown preset {preset!r}")
            out = replace(out, byte_order=ByteOrder.HOST, supports_palette=False, row_pad=0)
        for name, value in given.items():
            match name:
                case "byteorder":
                    out = replace(out, byte_order=ByteOrder[str(value).upper()])
                case "supportspalette":
                    out = replace(out, supports_palette=_truth(value))
                case "bgrtorgb":
                    out = replace(out, bgr_to_rgb=_truth(value))
                case "rowpad":
                    out = replace(out, row_pad=int(value))
                case "openintent":
                    if value not in INTENTS:
                        raise ValueError(f"unknown openIntent {value!r}")
                    out = replace(out, open_intent=str(value))
                case "maxpixels":
                    out = replace(out, max_pixels=int(value))
                case "supportedformats" | "supportedorientations" | "supportedcompressions" | "mmap" | "bmpskippedmode":
                    pass  # reserved
                case _:
                    raise ValueError(f"unknown option {name!r}")
        return out


def _truth(value: object) -> bool:
    return value if isinstance(value, bool) else str(value).lower() in ("true", "1", "yes")
