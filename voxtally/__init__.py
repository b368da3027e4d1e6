"""voxtally: scoring and analysis of speech transcription experiments on Spark DataFrames."""

__version__ = "0.1.0"
