"""pixeltide: Spark jobs over annotated-frame datasets (poses, pixels, boxes, labels, manifests)."""

__version__ = "0.1.0"
