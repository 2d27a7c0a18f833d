"""paperloom: document analytics on Spark.

Decoding turns files into relational tables; everything after that is DataFrame and SQL.
"""

__version__ = "0.1.0"
