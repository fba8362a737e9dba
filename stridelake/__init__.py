"""stridelake: ordered pose-sequence and identity analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
