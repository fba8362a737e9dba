"""Column functions that read identities, views and epochs from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: View words at the end of a name.
VIEWS = ("F", "S", "front", "side")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def identity_a(name: Column) -> Column:
    """Without a trailing view word, or without the two last parts where the view word is the last but one; else the first part."""
    parts = F.split(name, "_")
    n = F.size(parts)
    last, before = F.element_at(parts, -1), F.when(n >= 2, F.get(parts, n - 2))
    cut = lambda k: F.array_join(F.slice(parts, 1, F.greatest(n - k, F.lit(0))), "_")
    return F.when((n >= 2) & last.isin(*VIEWS), cut(1)).when((n >= 3) & before.isin(*VIEWS), cut(2)).otherwise(parts[0])


def identity_b(name: Column) -> Column:
    """All but the last part."""
    return F.regexp_replace(name, "_[^_]*$", "")


def identity_c(name: Column) -> Column:
    """struct of identity (first part), view (second, or unknown) and is_augmented (more than two parts)."""
    parts = F.split(name, "_")
    return F.struct(parts[0].alias("identity"), F.coalesce(F.get(parts, 1), F.lit("unknown")).alias("view"), (F.size(parts) > 2).alias("is_augmented"))


#: Views of originals by exact name, and what marks an augmented one.
ORIGINAL_VIEWS, MARK = ("F1", "F2", "F3", "S1", "S2", "S3"), "_aug"


def is_original(name: Column, rule: str) -> Column:
    """Whether a name is of an original: by "parts" (two at most), by "view" (two, the last one of ORIGINAL_VIEWS), by "mark" (no MARK)."""
    parts = F.split(name, "_")
    if rule == "parts":
        return F.size(parts) <= 2
    if rule == "view":
        return (F.size(parts) == 2) & F.get(parts, 1).isin(*ORIGINAL_VIEWS)
    if rule == "mark":
        return ~F.contains(F.lower(name), F.lit(MARK))
    raise ValueError(f"no rule {rule}")


def swapped_names(name: Column) -> Column:
    """struct of body and face of a name {body}_body_{face}_face."""
    parts = F.split(name, "_body_")
    return F.struct(parts[0].alias("body"), F.replace(F.get(parts, 1), F.lit("_face"), F.lit("")).alias("face"))


def best_epoch(path: Column) -> Column:
    """The epoch of a file name with epoch_N_best, else null."""
    found = F.regexp_extract(path, r"epoch_(\d+)_best", 1)
    return F.when(found != "", found.cast("int"))
