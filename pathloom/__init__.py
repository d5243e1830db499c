"""Path expressions over DataFrames of documents, and a pipeline of training-data operators."""

__version__ = "0.1.0"
