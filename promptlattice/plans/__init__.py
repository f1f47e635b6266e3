"""Whole runs: settings, the accuracy run, the catalogue of queries."""
