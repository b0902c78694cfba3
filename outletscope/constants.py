"""Values the report fixes. Every operator takes them as arguments; these are the defaults."""

from __future__ import annotations

from datetime import date
from typing import NamedTuple

# --- fixed values -----------------------------------------------------------

MONTH_NAMES = (
    "Janvier", "Février", "Mars", "Avril", "Mai", "Juin",
    "Juillet", "Août", "Septembre", "Octobre", "Novembre", "Décembre",
)

HOLIDAYS_2025 = (
    date(2025, 1, 1),
    date(2025, 4, 21),
    date(2025, 5, 1),
    date(2025, 5, 8),
    date(2025, 5, 29),
    date(2025, 6, 9),
    date(2025, 7, 14),
    date(2025, 8, 15),
    date(2025, 11, 1),
    date(2025, 11, 11),
    date(2025, 12, 25),
)

SEND_DAY = 17
TRAILING_MONTHS = 6
SINCE_PERIOD = 202503

FOCUS_LAB = "401884"  # lab keys are text in the domain
REPORT_GROUP = 406
MIN_SHARE = 0.4
MIN_OUTLET_ID = 2
GAP_TARGETS = (30, 50)
BAND_LOW, BAND_HIGH = 50, 80
BAND_LOW_NAME, BAND_HIGH_NAME = "pdm-low", "pdm-high"

TYPE_ORIGINATOR = "P"
TYPE_GENERIC = "G"
TYPES_GENERIC_TOTAL = ("G", "A")
TYPES_BIOSIMILAR = ("R", "B")

OUTLET_WORD = "Pharmacie"
NO_DATA_TEXT = "Aucune donnée disponible pour ce mois."
STATUS_OK = "OK"
STATUS_ERROR = "ERREUR"
SUMMARY_TEXT = "Bilan de l'envoi des rapports du %s\n - Envoyés OK : %d\n - En erreurs : %d\n\nDétails des erreurs :\n"
NO_ERROR_TEXT = "Aucune erreur rencontrée."
LABEL_WIDTH, LAB_WIDTH, DEFAULT_WIDTH = 80, 25, 50

QUOTA_FIRST, QUOTA_STEP = 2500, 4500


class MoleculeRule(NamedTuple):
    """A name belongs to the first rule whose `include` it contains and whose `exclude` it does not."""

    sort_order: int
    molecule: str
    display: str
    include: str
    exclude: str | None = None


MOLECULE_RULES = (
    MoleculeRule(1, "FILGRASTIM", "FILGRASTIM (ZARZIO)", "FILGRASTIM", "PEG"),
    MoleculeRule(2, "PEGFILGRASTIM", "PEGFILGRASTIM (ZIEXTENZO)", "PEGFILGRASTIM"),
    MoleculeRule(3, "EPOETINE", "EPOETINE (BINOCRIT)", "EPOETINE"),
    MoleculeRule(4, "ETANERCEPT", "ETANERCEPT (ERELZI)", "ETANERCEPT"),
    MoleculeRule(5, "ADALIMUMAB", "ADALIMUMAB (HYRIMOZ)", "ADALIMUMAB"),
    MoleculeRule(6, "ENOXAPARINE", "ENOXAPARINE (ENOXAPARINE BECAT)", "ENOXAPARINE"),
)

GROUP_PREFIXES = (
    "filgrastim", "pegfilgrastim", "epoetine", "etanercept", "adalimumab", "enoxaparine",
)

TOTAL_NAME, TOTAL_SORT = "TOTAL", 999

# a share of this size or more is an error of its outlet
SHARE_LIMIT = 100_000_000
