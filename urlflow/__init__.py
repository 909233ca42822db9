"""Crawl-data analytics on PySpark."""
