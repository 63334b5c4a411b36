"""Catalog names: normal form and molecule. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of dosage forms and units that say nothing about which product it is.
FORM_WORDS = [
    "tab", "tabs", "tablet", "tablets", "cap", "caps", "capsule", "capsules",
    "syrup", "syp", "susp", "suspension", "inj", "injection", "drop", "drops",
    "cream", "ointment", "gel", "lotion", "solution", "sachet", "strip",
    "mg", "mcg", "ml", "gm", "g", "iu", "%",
]


def tokens(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def _without_forms(t: Column) -> Column:
    kept = F.filter(t, lambda x: ~x.isin(FORM_WORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(t)


def normalize(name: Column) -> Column:
    """Lower-case tokens but form words, unless there is nothing else; null gives the empty string."""
    return F.array_join(_without_forms(tokens(name)), " ")


def base_molecule(name: Column) -> Column:
    """The normal form's tokens without a digit."""
    return F.array_join(F.filter(_without_forms(tokens(name)), lambda x: ~x.rlike("[0-9]")), " ")


def molecule_of(composition: Column, name: Column) -> Column:
    """From the composition where there is one, else from the name."""
    return F.when(F.coalesce(composition, F.lit("")) != "", normalize(composition)).otherwise(base_molecule(name))
