"""The arithmetic of image limits, on sizes alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MOST_WIDTH, MOST_HEIGHT, MOST_BYTES = 640, 640, 350_000


def fitted(width: Column, height: Column, most_width: int = MOST_WIDTH, most_height: int = MOST_HEIGHT) -> Column:
    """(width, height) within the limits at the same ratio; smaller ones stay."""
    factor = F.least(F.lit(1.0), F.lit(float(most_width)) / width, F.lit(float(most_height)) / height)
    return F.struct(F.floor(width * factor).cast("long").alias("width"), F.floor(height * factor).cast("long").alias("height"))


def valid_region(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Whether a region lies at no negative place and has a size."""
    return F.coalesce((x >= 0) & (y >= 0) & (width > 0) & (height > 0), F.lit(False))


def quality(value: Column, least: int = 10, most: int = 100) -> Column:
    return F.least(F.greatest(value, F.lit(least)), F.lit(most))


def best_quality(sizes: Column, most_bytes: int = MOST_BYTES, start: int = 70, least: int = 30, step: int = 10) -> Column:
    """Of a map from quality to encoded bytes the first quality from ``start`` down whose image is small enough, else the least."""
    tried = F.lit(list(range(start, least - 1, -step)))
    return F.coalesce(F.get(F.filter(tried, lambda q: F.element_at(sizes, q) <= most_bytes), F.lit(0)), F.lit(least))


def shrunk(width: Column, height: Column, size: Column, most_bytes: int, step: int = 10, attempts: int = 5) -> Column:
    """(width, height, attempts): sides cut by ``step`` percent at a time until bytes in proportion to the area are few enough, at most ``attempts`` times."""
    share = lambda k: F.pow(F.lit(1 - step / 100), k)
    enough = F.filter(F.sequence(F.lit(0), F.lit(attempts)), lambda k: size * share(k) * share(k) <= most_bytes)
    k = F.coalesce(F.get(enough, F.lit(0)), F.lit(attempts))
    return F.struct(F.floor(width * share(k)).cast("long").alias("width"), F.floor(height * share(k)).cast("long").alias("height"), k.alias("attempts"))


def multimodal(text: Column, image_url: Column) -> Column:
    """A user's message of a text and, where there is one, an image, as JSON."""
    part = lambda **kw: F.struct(*(v.alias(k) for k, v in kw.items()))
    one = part(type=F.lit("text"), text=text, image_url=F.lit(None).cast("string"))
    two = part(type=F.lit("image_url"), text=F.lit(None).cast("string"), image_url=image_url)
    return F.to_json(part(role=F.lit("user"), content=F.when(image_url.isNull(), F.array(one)).otherwise(F.array(one, two))))
