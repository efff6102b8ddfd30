"""ladder — panel and survey analytics for social-mobility studies on Spark DataFrames.

Sub-packages:

* ``ladder.functions``  Column -> Column helpers and the fixed code/label dictionaries.
* ``ladder.operators``  DataFrame -> DataFrame operators (filters, means, shares, pivots, mobility).
* ``ladder.sources``    reading the input tables, the derived test views, materialised tables, sinks.
* ``ladder.plans``      the composed dashboard queries and their SQL oracles.
* ``ladder.streaming``  intentionally empty (the reference has no streaming work).

No operator creates a SparkSession; every function takes DataFrames (or a session) from the caller.
"""

__version__ = "0.1.0"
