"""cartalog: Spark-native search, routing and clean-up of tagged geographic data."""

__version__ = "0.1.0"
