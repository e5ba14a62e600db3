"""Analytics over wide, sparse record tables and vector catalogs, as Spark DataFrame plans."""

__version__ = "0.1.0"
