"""Reading the corpus, deriving its tables, and writing results."""
