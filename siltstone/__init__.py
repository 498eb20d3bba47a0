"""A PySpark engine for hierarchical measurements, cumulative curves and their honest evaluation."""
