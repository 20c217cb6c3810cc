"""boxlens: object-detection dataset analytics as Spark DataFrame operators.

Tables (samples, annotations, categories, embeddings, annotation_triage, saved_views,
datasets) are plain DataFrames.  Every operator is a function DataFrame(s) -> DataFrame,
built from Spark SQL expressions so Catalyst can push filters, prune columns and pick join
strategies.  See ``boxlens.plans.catalog`` for the registered queries.
"""

from boxlens.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
