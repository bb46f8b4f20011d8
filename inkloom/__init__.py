"""Print-layer quality and adaptive-semantics analytics as Spark jobs.

Tables of pixels, masks, layers, detections, run episodes, audit reports and a
weighted category lexicon go in; DataFrames come out.  Every operator has the
shape ``op(df, ..., **params) -> DataFrame`` and stays lazy.
"""
