"""Least-cost routing over raster friction surfaces, and training-text operators (``fellpath.llm``), on PySpark."""
