"""Origin-destination flow and labour-demand analytics on Spark DataFrames."""

__version__ = "0.1.0"
