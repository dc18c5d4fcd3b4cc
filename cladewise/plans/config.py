"""Options of an analysis, with the checks of which go together."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class Covariance(Enum):
    CONST = "const"
    DIAG = "diag"
    DIST = "dist"
    LOWR = "lowr"


@dataclass(frozen=True)
class AnalysisConfig:
    """Defaults of a posterior analysis; impossible combinations raise ``ValueError``."""

    dimensionality: int = 5
    samples: int = 100
    batch_size: int = 10
    least_batches: int = 200
    block: int = 50
    learning_rate: float = 0.05
    covariance: Covariance = Covariance.CONST
    rank: int = 3
    hyperbolic: bool = False
    curvature: float = 1.0
    radial_flow: bool = False
    planar_flow: bool = False
    ultrametric: bool = False
    crispr: bool = False
    tree_prior: str | None = None
    relaxed_clock: bool = False
    migration: bool = False
    primary_state: str | None = None
    labelled_trees: bool = False
    sample_graphs: bool = False
    has_tree: bool = False
    has_distances: bool = False
    tree_only: bool = False
    has_data: bool = True

    def __post_init__(self) -> None:
        wrong = [text for text, bad in self._rules() if bad]
        if wrong:
            raise ValueError("; ".join(wrong))

    @property
    def curved(self) -> bool:
        """Hyperbolic space without curvature is Euclidean."""
        return self.hyperbolic and self.curvature > 0

    def _rules(self) -> list[tuple[str, bool]]:
        return [
            ("a tree and distances exclude each other", self.has_tree and self.has_distances),
            ("flows need Euclidean space", (self.radial_flow or self.planar_flow) and self.hyperbolic and self.curvature > 0),
            ("curvature must not be negative", self.curvature < 0),
            ("a tree prior goes with neither barcodes nor ultrametric trees", self.tree_prior is not None and (self.crispr or self.ultrametric)),
            ("a relaxed clock needs a tree prior", self.relaxed_clock and self.tree_prior is None),
            ("migration needs barcodes", self.migration and not self.crispr),
            ("a primary state, labelled trees and graphs need migration", not self.migration and (self.primary_state is not None or self.labelled_trees or self.sample_graphs)),
            ("a tree from given distances or a given tree takes no data", self.tree_only and (self.has_tree or self.has_distances) and self.has_data),
            ("counts and rates must be above zero", min(self.dimensionality, self.samples, self.batch_size, self.least_batches, self.block, self.rank) < 1 or self.learning_rate <= 0),
        ]

    def check_primary(self, states: set[str]) -> None:
        """An unknown primary state is an error."""
        if self.primary_state is not None and self.primary_state not in states:
            raise ValueError(f"no cell has the state {self.primary_state}")
