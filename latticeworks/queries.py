"""The library's own queries (the reference's operators) and their SQL."""

from .jobs import document_jobs, grid_jobs, model_jobs, spatial_jobs, structure_jobs  # noqa: F401
from .jobs.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
