"""shelfmark: build filtered product-search datasets with Spark DataFrames."""

__version__ = "0.1.0"
