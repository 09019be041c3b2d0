"""Findings, worlds, lineage and incremental loads as data frames."""
