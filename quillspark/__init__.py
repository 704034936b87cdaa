"""quillspark: document-to-narration analytics expressed as Spark DataFrame plans."""
