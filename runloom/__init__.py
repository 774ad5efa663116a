"""Job-queue analytics as DataFrame, SQL and Structured Streaming operators.

Every operator takes DataFrames and an explicit ``as_of`` instant and returns a
lazy DataFrame. Stored timestamps are ``TIMESTAMP_NTZ`` in UTC with millisecond
precision; the session time zone must be UTC (see :mod:`runloom.session`).
"""

__version__ = "0.1.0"
