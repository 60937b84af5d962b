"""Bed-occupancy analytics for many facilities, on Spark DataFrames."""
