"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom.constants import DATE_PLACEHOLDER, UNKNOWN_SEX_WORDS


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def normalise_name(name: Column | str) -> Column:
    """Feature name from a concept name: other characters become `_`, then lower case."""
    return F.lower(F.regexp_replace(_col(name), "[^A-Za-z_0-9]", "_"))


def unify_unknown(value: Column | str) -> Column:
    """The several spellings of an unknown sex become `unknown`."""
    return F.when(F.lower(_col(value)).isin(*UNKNOWN_SEX_WORDS), F.lit("unknown")).otherwise(_col(value))


def regroup(value: Column | str, groups: Mapping[str, Iterable[str]]) -> Column:
    """Replace each listed spelling by its group name, leaving other values alone."""
    value = _col(value)
    out = value
    for name, spellings in groups.items():
        out = F.when(value.isin(*spellings), F.lit(name)).otherwise(out)
    return out


def banded(value: Column | str, bands: Iterable[tuple[int, int | None, str]]) -> Column:
    """Label of the inclusive band (low, high, label) holding the value, else `unknown`."""
    value = _col(value)
    out = F.lit("unknown")
    for low, high, label in bands:
        inside = value >= low if high is None else value.between(low, high)
        out = F.when(inside, F.lit(label)).otherwise(out)
    return out


def approximate_age(anchor: Column | str, year_of_birth: Column | str) -> Column:
    return F.year(_col(anchor)) - _col(year_of_birth)


def encounter_key(episode_id: Column | str, visit_id: Column | str) -> Column:
    """An episode counts as one encounter; a visit outside any episode counts on its own."""
    return F.coalesce(_col(episode_id), _col(visit_id).cast("string"))


def date_text(value: Column | str, placeholder: str = DATE_PLACEHOLDER) -> Column:
    """Date as yyyy-MM-dd text with a placeholder for a missing date."""
    return F.coalesce(F.date_format(_col(value), "yyyy-MM-dd"), F.lit(placeholder))


def key_uniform(*keys: Column | str, seed: int) -> Column:
    """Number in [0, 1) that depends only on the key values and the seed.

    Unlike `rand`, it does not change with partitioning or with a task retry."""
    text = F.concat_ws("|", *[_col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def model_column(value: str) -> str:
    """Column name of a one-hot column."""
    return value.replace(" ", "_").lower()
