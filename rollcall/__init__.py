"""rollcall: attendance analytics for entity-by-day data, as Spark plans.

Every operator takes and returns DataFrames and stays lazy unless its
docstring says that it runs jobs (fits, iterative network measures).
"""
