"""Annotation audits, label datasets and sagittal alignment metrics as Spark DataFrame operators."""

__version__ = "0.1.0"
