import pytest

from cladewise.plans.config import AnalysisConfig


def test_defaults_and_rules():
    assert AnalysisConfig().samples == 100 and not AnalysisConfig(hyperbolic=True, curvature=0.0).curved
    AnalysisConfig(radial_flow=True, hyperbolic=True, curvature=0.0)
    for bad in ({"has_tree": True, "has_distances": True}, {"radial_flow": True, "hyperbolic": True}, {"migration": True}, {"primary_state": "x"}, {"tree_prior": "yule", "crispr": True}, {"samples": 0}, {"tree_only": True, "has_tree": True}):
        with pytest.raises(ValueError):
            AnalysisConfig(**bad)
    with pytest.raises(ValueError):
        AnalysisConfig(crispr=True, migration=True, primary_state="x").check_primary({"y"})
