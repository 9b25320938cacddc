"""Operations of a training-data pipeline, one module for each.

Nothing outside this package imports it, apart from the guarded hook in
``__spark_entry__.py`` and ``corpus_pipeline.py``.
"""
