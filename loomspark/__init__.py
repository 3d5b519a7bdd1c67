"""loomspark: corpus preparation and training telemetry on PySpark DataFrames."""

__version__ = "0.1.0"
