"""inkfold: images of text, their layout and their corrected text as Spark DataFrames."""

__version__ = "0.1.0"
