"""Code-quality, similarity and corpus analytics on PySpark."""
