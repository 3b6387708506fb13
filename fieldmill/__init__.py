"""Fieldmill: the data side of structured extraction, as Spark jobs.

Documents go in, strict JSON comes out of a model; this package prepares the
training rows, scores the answers field by field, mines preference pairs and
ranks the runs of a sweep.  Everything is a DataFrame, SQL or Structured
Streaming job.
"""

__version__ = "0.1.0"
