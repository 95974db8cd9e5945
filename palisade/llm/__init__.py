"""Training-data operators: ten corpus operators, their queries and their SQL.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
