"""Point-in-time filing and price analytics as PySpark DataFrame operators."""

__version__ = "0.1.0"
