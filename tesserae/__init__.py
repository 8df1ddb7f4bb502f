"""tesserae: relational operators for image-sequence evidence and corpus preparation, on PySpark."""
