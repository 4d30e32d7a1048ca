"""Operators of a training-data pipeline over a table of documents.

One module per operator; ``catalog.py`` registers their queries.  Nothing
outside this package (and ``corpus_pipeline.py``) imports it.
"""
