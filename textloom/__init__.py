"""Spark-first segmentation and chunking of text, tables, code, vectors and documents."""
