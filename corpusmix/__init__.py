"""corpusmix: data selection for training corpora as lazy PySpark plans."""

__version__ = "0.1.0"
