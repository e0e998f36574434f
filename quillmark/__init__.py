"""quillmark: corpus evidence analytics expressed as PySpark DataFrame plans."""
