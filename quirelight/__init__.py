"""A PySpark engine for corpora of PDF documents and large text collections."""
