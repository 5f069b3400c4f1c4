"""logsift: log-sequence anomaly analytics expressed as Spark DataFrame jobs.

Layers
------
functions/  column expressions (line layout, timestamps, keys, array strings)
sources/    readers (raw text logs, label CSV, saved datasets), fixtures, writers
operators/  ordering slices, sequences, windows, labels, features, models, metrics
plans/      end-to-end runs (block supervised, window unsupervised)
streaming/  Structured Streaming forms of parse, windows and scoring
"""

from logsift.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
