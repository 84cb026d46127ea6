"""Scalar and array expressions, all inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Colours (blue, green, red) by which tracks are told apart on screen.
COLOURS = (
    (0, 255, 0),
    (0, 0, 255),
    (255, 0, 0),
    (0, 255, 255),
    (255, 0, 255),
    (255, 255, 0),
    (0, 165, 255),
    (128, 0, 128),
    (203, 192, 255),
    (0, 255, 127),
    (147, 20, 255),
    (255, 144, 30),
    (0, 69, 255),
    (50, 205, 50),
    (0, 215, 255),
)


def track_colour(index: Column) -> Column:
    palette = F.array(*[F.array(*[F.lit(v) for v in c]) for c in COLOURS])
    return F.get(palette, F.pmod(index, F.lit(len(COLOURS))).cast("int"))


def any_colour(seed: int) -> Column:
    return track_colour(F.floor(F.rand(seed) * len(COLOURS)))


def next_power_of_2(x: Column) -> Column:
    return F.when(x <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(x - 1))).cast("long"))


def power_to_db(x: Column) -> Column:
    return 10 * F.log10(x)


def luma(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def dequantised(q: Column, zero: Column | float, scale: Column | float) -> Column:
    return (q - zero) * scale


def softmax(logits: Sequence[Column]) -> list[Column]:
    top = F.greatest(*logits)
    parts = [F.exp(x - top) for x in logits]
    total = sum(parts[1:], parts[0])
    return [p / total for p in parts]


def label_of(labels: dict[str, str], category: Column) -> Column:
    """A category's label, or class_<id> where it has none."""
    found = F.lit(None).cast("string")
    for k, v in labels.items():
        found = F.when(category.cast("string") == k, F.lit(v)).otherwise(found)
    return F.coalesce(found, F.concat(F.lit("class_"), category.cast("string")))


def channel_means(pixels: Column, channels: int = 3) -> list[Column]:
    """Mean of every channel of an interleaved pixel array."""
    n = F.size(pixels)
    out = []
    for c in range(channels):
        own = F.transform(F.sequence(F.lit(c), n - 1, F.lit(channels)), lambda i: F.get(pixels, i))
        out.append(F.aggregate(own, F.lit(0.0), lambda a, v: a + v) / F.size(own))
    return out


def channels_first(pixels: Column, n_pixels: int, channels: int) -> Column:
    """(pixel, channel) order to (channel, pixel) order by index arithmetic."""
    at = F.sequence(F.lit(0), F.lit(n_pixels * channels - 1))
    return F.transform(at, lambda i: F.get(pixels, (F.pmod(i, F.lit(n_pixels)) * channels + F.floor(i / n_pixels)).cast("int")))


def last_repeated(x: Column) -> Column:
    """The array with its last element once more."""
    return F.concat(x, F.slice(x, -1, 1))


def resized(plane: Column, height: int, width: int, new_height: int, new_width: int) -> Column:
    """Bilinear resize of a row-major plane, sample centres aligned, edges clamped."""

    def sample(i: Column) -> Column:
        y = F.greatest((F.floor(i / new_width) + 0.5) * (height / new_height) - 0.5, F.lit(0.0))
        x = F.greatest((F.pmod(i, F.lit(new_width)) + 0.5) * (width / new_width) - 0.5, F.lit(0.0))
        y0, x0 = F.least(F.floor(y), F.lit(height - 1)), F.least(F.floor(x), F.lit(width - 1))
        y1, x1 = F.least(y0 + 1, F.lit(height - 1)), F.least(x0 + 1, F.lit(width - 1))
        at = lambda a, b: F.get(plane, (a * width + b).cast("int"))
        fy, fx = F.least(y - y0, F.lit(1.0)), F.least(x - x0, F.lit(1.0))
        return (at(y0, x0) * (1 - fx) + at(y0, x1) * fx) * (1 - fy) + (at(y1, x0) * (1 - fx) + at(y1, x1) * fx) * fy

    return F.transform(F.sequence(F.lit(0), F.lit(new_height * new_width - 1)), sample)


def area_means(plane: Column, height: int, width: int, factor: int) -> Column:
    """Area resize by a whole factor: the mean of every factor x factor block."""
    out_w = width // factor

    def block(i: Column) -> Column:
        y, x = F.floor(i / out_w) * factor, F.pmod(i, F.lit(out_w)) * factor
        cells = F.transform(F.sequence(F.lit(0), F.lit(factor * factor - 1)), lambda j: F.get(plane, ((y + F.floor(j / factor)) * width + x + F.pmod(j, F.lit(factor))).cast("int")))
        return F.aggregate(cells, F.lit(0.0), lambda a, v: a + v) / (factor * factor)

    return F.transform(F.sequence(F.lit(0), F.lit((height // factor) * out_w - 1)), block)
