"""Operations of a large-scale training-data pipeline, as Spark jobs.

Nothing outside this subpackage imports it.
"""
