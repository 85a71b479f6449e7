"""Training-data operators: ten document-scale operations and their queries.

Nothing outside this package imports it; `__spark_entry__.py` adds its queries
only where the package is present.
"""
