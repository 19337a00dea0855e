"""Spark-native harmonisation and analysis of public register disclosures."""

__version__ = "0.1.0"
