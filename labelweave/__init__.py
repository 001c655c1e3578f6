"""labelweave: multi-label decision optimisation and training-data preparation on Spark."""

__version__ = "0.1.0"
