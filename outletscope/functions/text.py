"""Labels and display text as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from outletscope.constants import DEFAULT_WIDTH, OUTLET_WORD, MoleculeRule


def or_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def spaced(*parts: Column) -> Column:
    """Right-trimmed parts with one space between each; a missing part leaves its spaces behind."""
    pieces: list[Column] = []
    for part in parts:
        pieces += [F.lit(" "), or_blank(F.rtrim(part))]
    return F.concat(*pieces[1:])


def presentation_label(short_label: Column, pack: Column, volume: Column, unit: Column) -> Column:
    return F.rtrim(spaced(short_label, pack, volume, unit))


def substance_name(dci: Column, dose: Column, form: Column) -> Column:
    return spaced(dci, dose, form)


def outlet_label(name: Column, postcode: Column, town: Column, word: str = OUTLET_WORD) -> Column:
    """``name - postcode  town``, with ``word`` put in front of a name that does not contain it."""

    def trimmed(c: Column) -> Column:
        return or_blank(F.btrim(c, F.lit(" \t\r\n")))

    has_word = trimmed(name).rlike(rf"(?i){re.escape(word)}\b")
    full_name = F.when(has_word, trimmed(name)).otherwise(F.concat(F.lit(f"{word} "), trimmed(name)))
    return F.concat(full_name, F.lit(" - "), trimmed(postcode), F.lit("  "), trimmed(town))


def cut_text(text: Column, width: int = DEFAULT_WIDTH) -> Column:
    """Text over ``width`` characters is cut there and gets one trailing space."""
    cut = F.concat(F.substring(text, 1, width), F.lit(" "))
    return F.when(F.char_length(text) > width, cut).otherwise(text)


def capitalise(text: Column) -> Column:
    """All lower case but for the first character of the whole text."""
    lower = F.lower(text)
    return F.concat(F.upper(F.substring(lower, 1, 1)), F.substr(lower, F.lit(2)))


def money_text(amount: Column) -> Column:
    return F.concat(F.round(amount, 2).cast("decimal(20,2)").cast("string"), F.lit("€"))


def percent_text(share: Column) -> Column:
    """A share without trailing zeros: ``33.3 %``, ``50 %``."""
    digits = share.cast("decimal(20,2)").cast("string")
    return F.concat(F.regexp_replace(digits, r"\.?0+$", ""), F.lit(" %"))


def matches_rule(name: Column, rule: MoleculeRule) -> Column:
    """Case-insensitive: ``name`` holds the rule's text and not the excluded one."""
    upper = F.upper(name)
    found = upper.contains(rule.include.upper())
    return found & ~upper.contains(rule.exclude.upper()) if rule.exclude else found


def classify_molecule(name: Column, rules: Sequence[MoleculeRule]) -> Column:
    """Sort order of the first rule a name matches, NULL for none."""
    chain = F
    for rule in sorted(rules):
        chain = chain.when(matches_rule(name, rule), F.lit(rule.sort_order))
    return chain.otherwise(None)


def starts_with_any(text: Column, prefixes: Sequence[str]) -> Column:
    """Whether ``text`` starts with one of the prefixes, in any case: one pattern, so the text is built once."""
    alternatives = "|".join(re.escape(prefix) for prefix in prefixes)
    return text.rlike(rf"(?iu)\A(?:{alternatives})")
