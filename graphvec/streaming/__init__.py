"""Streaming.

The engine this library re-creates is a batch job: it has no stream source,
watermark, windowed aggregation or state. Nothing here is implemented on
purpose; every operator in ``graphvec.operators`` is a batch DataFrame
transformation and can be applied to a ``foreachBatch`` micro-batch if a
caller needs it.
"""
