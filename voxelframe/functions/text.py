"""Descriptions, names and JSON: the text side of layouts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def imagej_value(description: Column, key: str) -> Column:
    """The first line ``key=number`` of an ImageJ description, any case, that parses as an integer."""
    lines = F.split(F.coalesce(description, F.lit("")), "\r?\n")
    pairs = F.filter(lines, lambda s: F.lower(F.trim(F.substring_index(s, "=", 1))) == key.lower())
    numbers = F.filter(F.transform(pairs, lambda s: F.trim(F.substring_index(s, "=", -1)).try_cast("long")), lambda n: n.isNotNull())
    return F.try_element_at(numbers, F.lit(1)).cast("long")


def imagej_layout(description: Column, pages: Column) -> dict[str, Column]:
    """T, C and Z of an ImageJ stack: what it names, slices from the rest; null where the product is not the page count."""
    images = F.coalesce(imagej_value(description, "images"), pages)
    c = F.coalesce(imagej_value(description, "channels"), F.lit(1))
    t = F.coalesce(imagej_value(description, "frames"), F.lit(1))
    z = F.coalesce(imagej_value(description, "slices"), F.floor(images / (c * t)))
    ok = (t * c * z == pages) & description.startswith("ImageJ=")
    return {"t": F.when(ok, t), "c": F.when(ok, c), "z": F.when(ok, z)}


def imagej_description(t: Column, c: Column, z: Column) -> Column:
    return F.concat(F.lit("ImageJ=\nimages="), (t * c * z).cast("string"), F.lit("\nchannels="), c.cast("string"), F.lit("\nslices="), z.cast("string"), F.lit("\nframes="), t.cast("string"), F.lit("\nhyperstack="), F.when(t * c * z > 1, "true").otherwise("false"), F.lit("\n"))


def ome_pixels(order: str, x: Column, y: Column, z: Column, c: Column, t: Column) -> Column:
    """The element that describes the pixels of a stack."""
    return F.concat(F.lit(f'<Pixels DimensionOrder="{order}" Type="uint16" SizeX="'), x.cast("string"), F.lit('" SizeY="'), y.cast("string"), F.lit('" SizeZ="'), z.cast("string"), F.lit('" SizeC="'), c.cast("string"), F.lit('" SizeT="'), t.cast("string"), F.lit('"/>'))


def canonical_axes(axes: Column) -> Column:
    """The axes of a stack, upper-cased; a page axis of unknown kind (Q or I) before YX is Z."""
    up = F.upper(axes)
    return F.when(up.rlike("^[QI]YX$"), "ZYX").otherwise(up)


def valid_layout(axes: Column, rank: Column) -> Column:
    """A layout in lower case if it names ``rank`` distinct axes of T, C, Z, Y, X with Y and X, else null."""
    low = F.lower(F.trim(axes))
    distinct = F.size(F.array_distinct(F.split(low, ""))) == F.length(low)
    return F.when(low.rlike("^[tczyx]+$") & (F.length(low) == rank) & low.contains("y") & low.contains("x") & distinct, low)


def output_name(path: Column, extension: str) -> Column:
    """The default output beside the input: its last extension replaced, or, for ``tif``, just removed where a TIFF name is left."""
    stem = F.regexp_replace(path, r"\.[^./\\]*$", "")
    swapped = F.concat(stem, F.lit(f".{extension}"))
    return F.when(stem.rlike(r"(?i)\.tiff?$"), stem).otherwise(swapped) if extension == "tif" else swapped


def dataset_name(name: Column, default: str = "/data") -> Column:
    """An absolute dataset name: trimmed, the default if empty; null for empty or dot steps and a slash at the end."""
    bare = F.trim(F.coalesce(name, F.lit("")))
    full = F.when(bare == "", default).when(bare.startswith("/"), bare).otherwise(F.concat(F.lit("/"), bare))
    return F.when(~(full.endswith("/") | full.contains("//") | full.contains("/./") | full.contains("/../")), full)


def layout_json(shape: list[Column], axes: str, dtype: str) -> Column:
    """The layout header of an array: JSON of shape, axes and element type."""
    return F.to_json(F.struct(F.array(*shape).alias("shape"), F.lit(axes).alias("axes"), F.lit(dtype).alias("dtype")))


#: Units of length in micrometres; ``meter`` and ``metre`` forms, singular and plural, are derived.
MICROMETRES = {"nm": 0.001, "um": 1.0, "µm": 1.0, "μm": 1.0, "micron": 1.0, "microns": 1.0, "mm": 1000.0, "cm": 10000.0, "m": 1000000.0}
MICROMETRES |= {f"{prefix}met{ending}{s}": MICROMETRES[short] for prefix, short in (("nano", "nm"), ("micro", "um"), ("milli", "mm"), ("centi", "cm"), ("", "m")) for ending in ("er", "re") for s in ("", "s")}


def micrometres(size: Column, unit: Column) -> Column:
    """A length in micrometres; an unknown unit gives null."""
    table = F.create_map(*[F.lit(x) for pair in MICROMETRES.items() for x in pair])
    return size * F.try_element_at(table, F.lower(F.trim(unit)))


def pixel_size(numerator: Column, denominator: Column, unit: Column) -> Column:
    """Micrometres of a pixel from a resolution in pixels an inch (2) or a centimetre (3); null for 0 or another unit."""
    base = F.when(unit == 2, 25400.0).when(unit == 3, 10000.0)
    return F.when((numerator > 0) & (denominator > 0), base * denominator / numerator)


def property_value(typed: Column) -> dict[str, Column]:
    """A property written as a type letter and its text: I and L integers, D and F numbers, B a truth value, else text."""
    kind, body = F.substring(typed, 1, 1), F.substring(typed, 2, 1 << 30)
    return {
        "kind": kind,
        "as_long": F.when(kind.isin("I", "L", "S", "Y"), body.try_cast("long")),
        "as_double": F.when(kind.isin("D", "F"), body.try_cast("double")),
        "as_text": F.when(kind.isin("T", "Z", "B"), body),
    }
