"""Operators for large-scale training-data pipelines.

One module per operator; ``registry`` holds their registered queries. Nothing
outside this package imports it except the guarded block in
``__spark_entry__.py``.
"""
