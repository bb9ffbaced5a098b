"""Spark jobs for grids, point clouds, residue sequences and structural tables."""
