"""Identifier, split and report-value normalization as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def header_token(header: Column) -> Column:
    """Id of a FASTA header: first white-space token without ``>``; the third of three or more ``|`` parts; cut at the first ``/``.

    Empty where there is no token (``>`` alone), null for a null header.  Each
    step uses the one before once, so the generated code stays small.
    """
    token = F.regexp_extract(header, r"^\s*>?+\s*(\S+)", 1)
    part = F.regexp_replace(token, r"^[^|]*\|[^|]*\|([^|]*).*$", "$1")
    return F.regexp_replace(part, r"/.*$", "")


def domain_of(id_col: Column) -> Column:
    """The domain an id names, in one spelling; null where the id is null or has no token.

    ``AF-`` domains lose their model number; of seven-character structure
    domains the first four characters count in lower case; the rest is kept.
    """
    unnumbered = F.regexp_replace(header_token(id_col), r"^(AF-.*?model_v)[0-9]+", "$1")

    def one(d: Column) -> Column:
        structure = d.rlike(r"^[0-9][A-Za-z0-9]{3}[A-Za-z0-9][0-9]{2}$")
        return F.when(structure, F.concat(F.lower(F.substring(d, 1, 4)), F.substring(d, 5, 3))).when(d != "", d)

    return F.get(F.transform(F.array(unnumbered), one), F.lit(0))


#: Spellings of each split, after removing everything but letters and lowering the case.
SPLIT_SPELLINGS = {
    "train": ("train", "training", "trn"),
    "val": ("val", "valid", "validation", "dev"),
    "test": ("test", "testing", "tst"),
    "holdout": ("holdout", "holdouts"),
}


def split_of(split: Column) -> Column:
    """``train``, ``val``, ``test`` or ``holdout``; null for null or unknown spellings."""
    letters = F.lower(F.regexp_replace(split, r"[^A-Za-z]", ""))
    out = F.when(F.lit(False), F.lit(""))
    for name, spellings in SPLIT_SPELLINGS.items():
        out = out.when(letters.isin(*spellings), F.lit(name))
    return out


def report_number(val: Column) -> Column:
    """A report value as double: spaces and thousands separators removed; null where it is no number."""
    return F.regexp_replace(val, r"[\s,_']", "").try_cast("double")
