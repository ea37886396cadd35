"""Exact nearest-neighbour analytics on Spark DataFrames."""

from .operators.knn import knn_join
from .schema import NEIGHBORS, POINTS, RUNS, Options
from .sources.points import points_from_columns, points_from_parquet, random_grid, read_points_csv, regular_grid, sequential_points, write_points_csv

__all__ = [
    "NEIGHBORS", "POINTS", "RUNS", "Options", "knn_join", "points_from_columns", "points_from_parquet", "random_grid", "read_points_csv", "regular_grid",
    "sequential_points", "write_points_csv",
]
