"""PySpark-native Bayesian-network structure learning over categorical tables."""

__version__ = "0.1.0"
