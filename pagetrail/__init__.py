"""Search and manage large collections of captured web pages with PySpark."""
