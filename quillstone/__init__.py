"""quillstone: a PySpark-native engine for scholarly document corpora."""

__version__ = "0.1.0"
