"""String helpers: cleaning, path parts and C-style number formatting."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .boxes import col, let

# Characters that are replaced by an underscore.
SPECIAL = "|@#!¡·$€%&()=?¿^*;:,¨´><+"


def clean_str(c) -> Column:
    return F.regexp_replace(col(c), "[" + SPECIAL.replace("^", "\\^") + "]", "_")


def image_key(path, root: str | None = None) -> Column:
    """Identity of an image or its label file: the path below ``root`` without suffix, so that equal names in two folders stay apart.

    Without a root it is the file's stem, for folders without subfolders.
    """
    if root is None:
        return stem(path)
    p = F.col(path) if isinstance(path, str) else path
    below = F.when(F.startswith(p, F.lit(root.rstrip("/") + "/")), F.substring(p, F.lit(len(root.rstrip("/")) + 2), F.length(p))).otherwise(p)
    return F.regexp_replace(below, r"\.[^./]*$", "")


def stem(path) -> Column:
    """Name without folder and suffix. The pattern sees the name only: in the folders it would try every letter as a start."""
    return F.regexp_extract(F.substring_index(col(path), "/", -1), r"([^/]*?)(\.[^./]*)?$", 1)


def suffix(path) -> Column:
    """Lower-cased extension without the dot, empty when there is none."""
    return F.lower(F.regexp_extract(col(path), r"\.([^./]*)$", 1))


def parent_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]+)/[^/]*$", 1)


def numeric_id(path) -> Column:
    """Stem as a number, NULL when it is not all digits."""
    s = stem(path)
    return F.when(s.rlike("^[0-9]+$"), s).try_cast("bigint")


def label_path(path) -> Column:
    """Label file that belongs to an image file: last ``/images/`` becomes ``/labels/``, suffix ``.txt``."""
    p = F.regexp_replace(col(path), r"^(.*)/images/", "$1/labels/")
    return F.concat(F.regexp_replace(p, r"\.[^./]*$", ""), F.lit(".txt"))


def format_g(c, digits: int = 6) -> Column:
    """C's ``%.{digits}g``: ``digits`` significant digits, no trailing zeros, exponent form for very small or large. Zero has no sign."""
    form = f"%.{digits}g"

    @F.arrow_udf("string")
    def written(numbers: pa.Array) -> pa.Array:
        return pa.array([None if v is None else form % v for v in pc.add(numbers, 0.0).to_pylist()], pa.string())

    return written(col(c).cast("double"))


def joined_g(numbers, digits: int = 6) -> Column:
    """The numbers of an array as :func:`format_g` writes them, one space between; nulls are left out, a null array stays null."""
    form = f"%.{digits}g"

    @F.arrow_udf("string")
    def written(lists: pa.Array) -> pa.Array:
        flat, out, at = pc.add(lists.flatten(), 0.0).to_pylist(), [], 0
        for n in pc.list_value_length(lists).to_pylist():
            out.append(None if n is None else " ".join([form % v for v in flat[at : at + n] if v is not None]))
            at += n or 0
        return pa.array(out, pa.string())

    return written(col(numbers).cast("array<double>"))


def plural_count(n, name) -> Column:
    """``2 persons`` / ``1 car``."""
    return F.concat(col(n).cast("string"), F.lit(" "), col(name), F.when(col(n) > 1, F.lit("s")).otherwise(F.lit("")))


def softmax(scores) -> Column:
    def powers(s):
        return let(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top)))

    def shares(e):
        return let(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))

    return let(let(F.transform(col(scores), lambda v: v.cast("double")), powers), shares)


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-col(c)))
