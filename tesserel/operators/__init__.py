"""Relational operators that Spark has no word for, as plans of those it has."""

from tesserel.operators.joins import asof_join, keyed_lookup, nullsafe_join, positional_join
from tesserel.operators.stars import columns, rename, replace, star_filter
from tesserel.operators.windows import groups_window, qualify

__all__ = ["asof_join", "columns", "groups_window", "keyed_lookup", "nullsafe_join", "positional_join", "qualify", "rename", "replace", "star_filter"]
