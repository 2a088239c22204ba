"""bookspark: a Spark-first engine for catalogues, paragraphs and full-text search of books."""

__version__ = "0.1.0"
