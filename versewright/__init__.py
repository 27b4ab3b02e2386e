"""A PySpark engine for hierarchically keyed text corpora and large training corpora."""
