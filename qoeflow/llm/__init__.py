"""Operators of a training-data pipeline over text, vectors and pages.

One module per operator; ``queries.REGISTRY`` holds the ``opN_<name>``
queries and ``queries.SQL`` their DuckDB twins.  Nothing outside this
subpackage (and ``corpus_pipeline.py``) imports it.
"""
