"""Recording analytics on PySpark: DataFrame programs for multi-channel signals, events, snippets and their catalogs."""

__version__ = "0.1.0"
