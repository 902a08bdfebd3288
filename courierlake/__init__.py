"""Courierlake: analytics over large message archives, on Spark DataFrames."""

__version__ = "0.1.0"
