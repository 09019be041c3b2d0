"""Witnesses: for each declared fact the rows that break it, for each hazard the rows it affects."""
