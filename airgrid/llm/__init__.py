"""Training-data operators: thirteen jobs over document, page, benchmark and embedding tables.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface (DataFrame in, DataFrame out); ``queries`` holds the registered queries and their SQL.
"""
