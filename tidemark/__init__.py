"""Recommendation analytics and event-log processing as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame. Sub-packages:

* ``sources``   - readers and writers
* ``functions`` - column expressions (text hygiene, hashing, vectors, label rules)
* ``operators`` - relational building blocks
* ``plans``     - whole jobs composed from operators
* ``streaming`` - Structured Streaming jobs
"""

from tidemark.session import local_session

__all__ = ["local_session"]
