"""Column expressions over paths, names and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEST_MARKS = (".test.", ".spec.", "__tests__/")


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding of ties upwards, on the binary value: 0.285 to 2 digits is 0.28."""
    scale = 10.0**digits
    return F.floor(x * F.lit(scale) + 0.5) / F.lit(scale)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def dirname(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def module_of(path: Column) -> Column:
    """The directory with its slash, ``.`` at the root."""
    return F.when(F.instr(path, "/") == 0, ".").otherwise(F.regexp_replace(path, "[^/]+$", ""))


def cloud_group(module: Column) -> Column:
    """At most two leading parts of a module, after a source folder's name; ``root`` without any."""
    parts = F.filter(F.split(module, "/"), lambda x: (x != "") & (x != "."))
    outer = F.element_at(parts, 1).isin("src", "lib", "app", "packages", "apps")
    inner = F.when((F.size(parts) > 1) & outer, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    return F.when(F.size(parts) == 0, "root").otherwise(F.array_join(F.slice(inner, 1, 2), "/"))


def is_test_path(path: Column) -> Column:
    out = F.lit(False)
    for mark in TEST_MARKS:
        out = out | F.contains(path, F.lit(mark))
    return out


def normalized_path(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"\\", "/"), "^(src|lib|app)/", "")


def name_tokens(text: Column) -> Column:
    """Lower-case words of identifiers and paths: case changes, ``_ - . / \\`` and white space part them."""
    apart = F.regexp_replace(F.regexp_replace(text, "([a-z])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    spaced = F.regexp_replace(apart, r"[_\-./\\]", " ")
    return F.filter(F.split(F.lower(spaced), r"[ \t\r\n\f\x0B]+"), lambda w: w != "")


def fan_coupling(fan_in: Column, fan_out: Column) -> Column:
    return F.when(fan_in + fan_out == 0, 0.0).otherwise(fan_out / (F.greatest(fan_in, F.lit(1)) + fan_out))
