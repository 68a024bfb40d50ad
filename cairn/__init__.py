"""cairn: analytics over catalogs of files, on PySpark DataFrames."""

__version__ = "0.1.0"
