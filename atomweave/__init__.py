"""Spark-native analytics over molecular structures and trajectories."""

__version__ = "0.1.0"
