"""Where a scanned page's columns part. Pages are binary rows; kernels are numpy, one page at a time.

Decoding needs Pillow, which is optional: ``decoded`` says so if it is absent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INK = 160


def longest_runs(ink: np.ndarray) -> np.ndarray:
    """G1: the longest unbroken vertical run of each column of a boolean page.

    A run's length is the distance to the last blank row above, so one running maximum does it.
    """
    rows = np.arange(1, ink.shape[0] + 1)[:, None]
    blank = np.maximum.accumulate(np.where(ink, 0, rows), axis=0)
    return np.where(ink, rows - blank, 0).max(axis=0, initial=0)


def rule_at(gray: np.ndarray) -> int:
    """The column of the printed rule, the longest run in the middle two fifths; -1 if it is under 6 % of the height."""
    ink = gray < INK
    h, w = ink.shape
    lo, hi = int(0.30 * w), int(0.70 * w)
    runs = longest_runs(ink[:, lo:hi])
    return lo + int(runs.argmax()) if len(runs) and runs.max() > 0.06 * h else -1


def gutter_at(gray: np.ndarray) -> int:
    """The middle of the widest run of nearly blank columns in the middle third; -1 if under 1 % of the width."""
    ink = gray < INK
    h, w = ink.shape
    lo, hi = int(0.32 * w), int(0.68 * w)
    quiet = np.r_[False, ink[:, lo:hi].sum(axis=0) <= max(2, 0.004 * h), False]
    edge = np.flatnonzero(quiet[1:] != quiet[:-1])
    start, size = edge[::2], edge[1::2] - edge[::2]
    if not len(size) or size.max() < 0.01 * w:
        return -1
    k = int(size.argmax())
    return lo + int(start[k]) + int(size[k]) // 2


def best_angle(turned: Callable[[float], np.ndarray], *, steps: int = 12, by: float = 0.25) -> float:
    """Of the angles within three degrees the one whose middle band has the longest run, if over 10 % of the height; else 0."""
    best, angle = 0, 0.0
    h = 1
    for k in range(-steps, steps + 1):
        if not k:
            continue
        ink = turned(k * by) < INK
        h, w = ink.shape
        run = int(longest_runs(ink[:, int(0.30 * w) : int(0.70 * w)]).max(initial=0))
        if run > best:
            best, angle = run, k * by
    return angle if best > 0.10 * h else 0.0


def split_at(rule: Column, gutter: Column, width: Column, side_median: Column) -> Column:
    """The rule if within 5 % of its side's median, else the gutter if within 2 %, else the median; as a share of the width."""
    r, g = rule / width, gutter / width
    return F.when((rule > 0) & (F.abs(r - side_median) <= 0.05), r).when((gutter > 0) & (F.abs(g - side_median) <= 0.02), g).otherwise(side_median)


def column_boxes(width: int, height: int, *, foot: float = 0.955, left: float = 0.52, right: float = 0.48) -> list[tuple[int, int, int, int]]:
    """Two overlapping columns with the footer cut off, as (left, top, right, bottom)."""
    bottom = int(height * foot)
    return [(0, 0, int(width * left), bottom), (int(width * right), 0, width, bottom)]


def decoded(content: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("decoding a page image needs Pillow") from e
    import io

    return np.asarray(Image.open(io.BytesIO(content)).convert("L"))


def stitched(strips: list[np.ndarray]) -> np.ndarray | None:
    """Strips of the same width, within two pixels, one above the other; with under two such, the largest image."""
    if not strips:
        return None
    w = max(s.shape[1] for s in strips)
    same = [s for s in strips if abs(s.shape[1] - w) <= 2]
    if len(same) < 2:
        return max(strips, key=lambda s: s.size)
    return np.vstack([np.pad(s, ((0, 0), (0, w - s.shape[1])), constant_values=255) for s in same])


def page_splits(pages: DataFrame, *, key: str = "page", pixels: str = "pixels", width: str = "width", decode: Callable[[bytes], np.ndarray] | None = None) -> DataFrame:
    """(page, rule, gutter, width) from raw grey pixels and a width, or from image bytes with ``decode``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, data, w in zip(f[key], f[pixels], f[width]):
                gray = decode(data) if decode else np.frombuffer(data, np.uint8).reshape(-1, w)
                out.append((k, rule_at(gray), gutter_at(gray), gray.shape[1]))
            yield pd.DataFrame(out, columns=[key, "rule", "gutter", "width"])

    return pages.select(key, pixels, width).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, rule int, gutter int, width int")


def rotated(gray: np.ndarray, degrees: float) -> np.ndarray:
    """The page turned about its middle, nearest pixel, white where nothing was."""
    h, w = gray.shape
    turn, y, x = np.deg2rad(degrees), *np.indices((h, w))
    dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
    sy = np.rint(dy * np.cos(turn) - dx * np.sin(turn) + (h - 1) / 2).astype(int)
    sx = np.rint(dy * np.sin(turn) + dx * np.cos(turn) + (w - 1) / 2).astype(int)
    inside = (sy >= 0) & (sy < h) & (sx >= 0) & (sx < w)
    out = np.full_like(gray, 255)
    out[inside] = gray[sy[inside], sx[inside]]
    return out


def _pages(pages: DataFrame, key: str, pixels: str, width: str, of: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """``of``'s rows for each page of raw grey pixels, with its key."""
    names = [key, *(x.split()[0] for x in schema.split(", "))]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(k, *r) for k, data, w in zip(f[key], f[pixels], f[width]) for r in of(np.frombuffer(data, np.uint8).reshape(-1, w))]
            yield pd.DataFrame(rows, columns=names)

    return pages.select(key, pixels, width).mapInPandas(run, f"`{key}` {pages.schema[key].dataType.simpleString()}, {schema}")


def straightened(pages: DataFrame, *, key: str = "page", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """(page, angle, pixels, width): each page turned by the angle that makes its rule upright."""

    def one(gray: np.ndarray) -> list[tuple]:
        angle = best_angle(lambda a: rotated(gray, a))
        return [(angle, (rotated(gray, angle) if angle else gray).tobytes(), gray.shape[1])]

    return _pages(pages, key, pixels, width, one, "angle double, pixels binary, width int")


def page_columns(pages: DataFrame, *, key: str = "page", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """(page, part, pixels, width, height): the two columns of each page, by ``column_boxes``."""

    def one(gray: np.ndarray) -> list[tuple]:
        boxes = column_boxes(gray.shape[1], gray.shape[0])
        return [(k, gray[top:bottom, left:right].tobytes(), right - left, bottom - top) for k, (left, top, right, bottom) in enumerate(boxes)]

    return _pages(pages, key, pixels, width, one, "part int, pixels binary, width int, height int")


def stitched_pages(strips: DataFrame, *, key: str = "page", place: str = "pos", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """(page, pixels, width, height): each page's strips (raw grey pixels) in order, one above the other."""
    kind = strips.schema[key].dataType.simpleString()

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(place)
        page = stitched([np.frombuffer(d, np.uint8).reshape(-1, w) for d, w in zip(f[pixels], f[width])])
        return pd.DataFrame([(f[key].iloc[0], page.tobytes(), page.shape[1], page.shape[0])], columns=[key, "pixels", "width", "height"])

    return strips.select(key, place, pixels, width).groupBy(key).applyInPandas(run, f"`{key}` {kind}, pixels binary, width int, height int")


def png(gray: np.ndarray) -> bytes:
    """A grey page as a PNG file, without a library: a header, the deflated rows, an end, each with its checksum."""
    import struct
    import zlib

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    h, w = gray.shape
    rows = np.hstack([np.zeros((h, 1), np.uint8), gray.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def cropped(pages: DataFrame, box: tuple[float, float, float, float], *, key: str = "page", pixels: str = "pixels", width: str = "width") -> DataFrame:
    """(page, png, width, height): the part of each page inside ``box`` (left, top, right, bottom as shares), for people to look at."""

    def one(gray: np.ndarray) -> list[tuple]:
        h, w = gray.shape
        left, top, right, bottom = (int(s * n) for s, n in zip(box, (w, h, w, h)))
        part = gray[top : max(bottom, top + 1), left : max(right, left + 1)]
        return [(png(part), part.shape[1], part.shape[0])]

    return _pages(pages, key, pixels, width, one, "png binary, width int, height int")
