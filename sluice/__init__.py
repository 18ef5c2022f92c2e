"""sluice: a Spark-first engine for software-change analytics and training-data preparation."""

__version__ = "0.1.0"
