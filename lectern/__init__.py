"""Package of the document analytics engine."""
