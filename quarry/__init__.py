"""quarry: hybrid search, text analytics and index maintenance expressed as Spark plans."""
