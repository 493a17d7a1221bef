"""Personal-data detection, redaction and evaluation on PySpark DataFrames."""

__version__ = "0.1.0"
