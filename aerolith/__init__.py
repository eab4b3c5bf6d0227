"""Aerolith: grids, lattice flows, meshes and mesh graphs as Spark DataFrames."""
