"""quarry: corpus-curation analytics expressed as Spark DataFrame and SQL plans."""
