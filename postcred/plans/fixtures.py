"""Deterministic fixture parameters for the oracle-checked queries.

LDA, k-means and the network are not reproducible by SQL, so the parity queries use fixed
stand-ins derived from the data with formulas both engines evaluate identically: a topic mixture
per post, a word distribution per topic, and fixed cluster centres.  The LDA-based versions of
the same operators are registered separately (rows-only checks).
"""

from __future__ import annotations

# Fixed fixture values.
FIXTURE_TOPICS = 4
FIXED_CENTERS = (
    (-0.5, -0.5, -0.5, -0.5, -0.5),
    (0.0, 0.0, 0.0, 0.0, 0.0),
    (1.0, 1.0, 1.0, 1.0, 1.0),
)
OTHER_CENTERS = (
    (0.6, 0.9, 0.6, 0.8, 0.9),
    (-0.2, -0.4, -0.5, -0.6, -0.3),
    (0.9, -0.1, 0.0, 0.1, -0.1),
)
BASIS_RANK, BASIS_START, BASIS_STEPS = 5, 0.5, 3
TEST_SHARE = 0.25
MINMAX_RANGE = (0, 10)


def theta_weight_sql(t: int, text_col: str) -> str:
    """Unnormalised weight of topic ``t`` in a post (normalised over topics afterwards)."""
    return f"CAST(((length({text_col}) * {t + 3}) + {t}) % 7 + 1 AS DOUBLE)"


def phi_weight_sql(t: int, term_col: str) -> str:
    """Unnormalised weight of a term in topic ``t`` (normalised over the vocabulary afterwards)."""
    return f"CAST((length({term_col}) + ascii({term_col}) * {t + 1}) % 5 + 1 AS DOUBLE)"


def net_weight(layer: int, i: int, j: int) -> float:
    """Weight from unit ``i`` to unit ``j`` of a layer of the fixture network."""
    return ((i * 7 + j * 3 + layer * 5) % 11 - 5) / 10


def net_bias(layer: int, j: int) -> float:
    return ((j + layer) % 5 - 2) / 10


def basis_value(j: int, i: int) -> float:
    """Value of feature ``i`` in component ``j`` of the fixture basis."""
    return ((j * 3 + i * 5) % 7 + 1) / 4
