"""Operators on DataFrames: pedigree walk, place resolution, report and map layers."""
