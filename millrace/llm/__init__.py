"""Training-data operators. Nothing else in millrace imports this subpackage."""
