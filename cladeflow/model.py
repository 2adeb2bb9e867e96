"""Constants, options and table shapes of the frequency time-series part.

Long form: (population, label, t, freq), one row a sampled point. Packed form: (population, label, fs), the
frequencies of a label in the order of t. ``population`` lets any number of experiments run side by side.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# fixed values of the model
DETECTED = 0.03
SIGNIFICANT = 0.15
MASKED_FIXED = 0.97
BREAKPOINTS = (1.0, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0)
SIMILARITY_QUANTILE = 0.05
DERIVATIVE_LIMIT = 0.01
SLIVER = 0.0001
VISIBLE = 0.01
ROOT = "genotype-0"
REMOVED = "removed"
ROOT_COLOR, REMOVED_COLOR = "#FFFFFF", "#333333"

LONG = "population string, label string, t int, freq double"


@dataclass
class Options:
    """Options of the whole analysis; weights are (greater, fixed, derivative, area)."""

    dlimit: float = DETECTED
    flimit: float | None = None
    slimit: float = SIGNIFICANT
    pvalue: float = 0.05
    metric: str = "binomial"
    similarity_cutoff: float | None = None
    quantile: float = SIMILARITY_QUANTILE
    weights: tuple[float, float, float, float] = (1, 1, 2, 2)
    frequencies: tuple[float, ...] = (0.9, 0.6, 0.3, 0.0)
    filter_single: bool = False
    filter_startfixed: bool = False
    filter_consistency: float = 0.0
    filter_genotypes: bool = False
    strict: bool = False
    name: str = "result"
    palette: str = "lineage"
    color_names: bool = True
    known_genotypes: list[list[str]] = field(default_factory=list)
    known_ancestry: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.flimit is None:
            self.flimit = 1 - self.dlimit


def parse_frequencies(text: str) -> list[float]:
    """A step ("0.3": from 1 - step downwards) or a list (".2,.4,.7") of breakpoints, in descending order, 0 at the end."""
    if "," in text:
        found = [float(x) for x in text.split(",")]
    else:
        step = float(text)
        found = [round(step * i, 6) for i in range(1, int(1 / step + 1e-9) + 1) if step * i < 1 - 1e-9]
    return sorted({*found, 0.0}, reverse=True)
