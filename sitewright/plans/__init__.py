from . import checks, contact_maps, designs, effects, motif_scans, positions, prespecified_plans, resampled, scored, variants
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
