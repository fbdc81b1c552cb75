"""Paths as column expressions: keys, names, extensions, folders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_key(path: Column) -> Column:
    """Identity of a record: slashes forward, lower case."""
    return F.lower(F.translate(path, "\\", "/"))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; "" without one. A name that only begins with a dot has none."""
    name = file_name(path)
    return F.lower(F.regexp_extract(name, r"^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    name = file_name(path)
    cut = F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)
    return F.when(cut == "", name).otherwise(cut)


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)[\\/][^\\/]*$", 1)


def covers(prefix: Column, key: Column) -> Column:
    """Whether key is prefix or lies below it."""
    return (key == prefix) | key.startswith(F.concat(prefix, F.lit("/")))
