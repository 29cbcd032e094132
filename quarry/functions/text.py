"""Text expressions: repair, names, identifiers, ordered classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented capitals and their plain forms.
ACCENTED, PLAIN = "ÁÀÂÄÃÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑ", "AAAAAEEEEIIIIOOOOOUUUUCN"

#: Legal forms that a company name may end with or hold; short ones also with their letters apart (S.A.C., S A C).
LEGAL_FORMS = ("SOCIEDAD ANONIMA CERRADA", "SOCIEDAD ANONIMA", "SAC", "SAA", "SA", "SRL", "EIRL", "INC", "LTD", "LLC", "CORP", "GMBH")
SPELLED = ("SAC", "SAA", "SA", "SRL", "EIRL")


def legal_pattern(forms: tuple[str, ...] = LEGAL_FORMS) -> str:
    """A pattern of whole legal forms, for names in capitals whose punctuation has become spaces."""
    return r"\b(" + "|".join(" ?".join(f) if f in SPELLED else f for f in forms) + r")\b"


def squeeze(col: Column) -> Column:
    """White space collapsed to single spaces, ends trimmed."""
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def repair(col: Column, replacements: dict[str, str] | None = None) -> Column:
    """Replace mis-decoded characters, squeeze white space, upper case."""
    for bad, good in (replacements or {}).items():
        col = F.replace(col, F.lit(bad), F.lit(good))
    return F.upper(squeeze(col))


def legal_name(col: Column, forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """A company name to compare by: upper case, no accents, no punctuation, no legal form, its letters together or apart."""
    bare = F.translate(F.upper(col), ACCENTED, PLAIN)
    bare = F.regexp_replace(bare, "[^A-Z0-9 ]", " ")
    return squeeze(F.regexp_replace(squeeze(bare), legal_pattern(forms), " "))


def classify(col: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first pattern that matches."""
    out = F.lit(default)
    for pattern, label in reversed(rules):
        out = F.when(col.rlike(pattern), F.lit(label)).otherwise(out)
    return out


def id_kind(col: Column) -> Column:
    """Kind of a tax identifier by its digits: company, person, local, foreign."""
    digits = F.regexp_replace(F.coalesce(col, F.lit("")), "[^0-9]", "")
    return F.when(digits.rlike("^20[0-9]{9}$"), "company").when(digits.rlike("^1[057][0-9]{9}$"), "person").when(digits.rlike("^[0-9]{6,7}$"), "local").otherwise("foreign")


def digits_only(col: Column) -> Column:
    """A whole number from text such as `1.234`; blanks and `NA` give null."""
    cleaned = F.regexp_replace(F.when(~F.trim(col).isin("", "NA"), col), "[^0-9-]", "")
    return F.when(cleaned != "", cleaned).try_cast("long")
