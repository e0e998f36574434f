"""Operators for large training-data pipelines; nothing else in quillmark imports them."""
