"""pairlab: pairwise-evaluation analytics as Spark DataFrame jobs.

Tables of keyed records become validated records, pairs, reproducible cohorts,
scored pairs, contract checks, score analytics and parity reports.  Library
functions take and return DataFrames or Columns and never collect rows; the
few driver-side values are named in their docstrings.
"""
