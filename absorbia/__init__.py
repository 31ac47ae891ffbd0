"""absorbia: high-dimensional fixed-effect econometrics expressed as Spark plans."""

__version__ = "0.1.0"
