"""interlinear: a Spark-native engine that prepares Markdown/HTML corpora for
machine translation and renders documents in which each block is followed
by its translation.

Every public operator takes DataFrames and returns DataFrames built from
native Spark expressions, windows, joins and aggregations.
"""

from interlinear.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
