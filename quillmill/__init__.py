"""quillmill: analytics over collections of text and code, expressed as Spark plans."""
