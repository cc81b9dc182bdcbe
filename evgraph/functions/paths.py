"""Paths with forward slashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def directory(path: Column) -> Column:
    """'' for a path without a directory."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """Lower-case, without the dot; '' without one."""
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def ancestors(path: Column) -> Column:
    """Every directory above a path, '' first: keys that turn a prefix join into an equi-join."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def segments(path: Column) -> Column:
    return F.split(path, "/")


def unsafe(path: Column) -> Column:
    """Rooted, or with a '..' segment."""
    return path.startswith("/") | path.rlike(r"^[A-Za-z]:") | F.array_contains(segments(normal(path)), "..")


def by_path(path: str = "path") -> Column:
    """Order of paths ignoring case: by upper-cased code units."""
    return F.upper(F.col(path))
