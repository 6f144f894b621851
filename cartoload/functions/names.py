"""Identifier cleaning (C1) as a column expression, with a twin for names read from file headers."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a ready-made SQL name, and the letters kept by cleaning.
SQL_NAME = r"^[A-Z_][A-Z_0-9]{1,64}\z"
# The long s and the Kelvin sign are the two non-ASCII letters that fold to A-Z.
KEPT_LETTERS = "A-Za-z_0-9\u017F\u212A"


def is_sql_name(name: Column) -> Column:
    return name.rlike(SQL_NAME)


def _scrubbed(name: Column) -> Column:
    name = F.regexp_replace(name, r"\.[^\n]+\z", "")
    name = F.regexp_replace(name, f"[^{KEPT_LETTERS}]", "_")
    name = F.regexp_replace(name, r"^([0-9])", "_$1")
    return F.lower(F.regexp_replace(name, r"_{2,}", "_"))


def try_clean_identifier(name: Column) -> Column:
    """Cleaned name, NULL where nothing is left of it."""
    return F.when(is_sql_name(name), F.lower(name)).otherwise(F.nullif(_scrubbed(name), F.lit("")))


def clean_identifier(name: Column, what: str = "Column name") -> Column:
    """Cleaned name; a name that is empty after cleaning fails the job."""
    failure = F.raise_error(F.format_string(what + ' "%s" was empty after cleaning', name))
    return F.when(name.isNotNull(), F.coalesce(try_clean_identifier(name), failure))


def clean_name(name: str, what: str = "Column name") -> str:
    """The same rule for a single name on the driver (file names, header cells)."""
    if re.fullmatch(r"[A-Z_][A-Z_0-9]{1,64}", name):
        return name.lower()
    kept = re.sub(r"\.[^\n]+\Z", "", name)
    kept = re.sub(f"[^{KEPT_LETTERS}]", "_", kept)
    kept = re.sub(r"\A(?=[0-9])", "_", kept)
    kept = re.sub(r"_{2,}", "_", kept).lower()
    if not kept:
        raise ValueError(f'{what} "{name}" was empty after cleaning')
    return kept


def clean_names(names: list[str]) -> list[str]:
    """Cleaned header names; two names that clean to the same text are refused."""
    cleaned = [clean_name(name) for name in names]
    repeated = sorted({name for name in cleaned if cleaned.count(name) > 1})
    if repeated:
        raise ValueError(f"Column names collide after cleaning: {', '.join(repeated)}")
    return cleaned


def table_name(path: str) -> str:
    return clean_name(posixpath.basename(path.rstrip("/")), "Table name")
