"""Evaluation of prompt compression, as Spark plans."""
