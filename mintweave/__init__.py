"""Launch forensics over whole markets, written as Spark DataFrame jobs.

Every operator takes DataFrames in the canonical schemas of
:mod:`mintweave.sources.schemas` and returns a DataFrame.  Nothing here runs
for one launch at a time: ``mint`` is a grouping column everywhere.
"""

__version__ = "0.1.0"
