"""Point-in-time analytics over property-style transaction records, on Spark."""

__version__ = "0.1.0"
