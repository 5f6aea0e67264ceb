"""quillspark: retrieval and text analytics as lazy PySpark DataFrame plans."""
