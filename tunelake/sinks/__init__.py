"""Writers: replace, merge, insert-or-replace, insert-or-ignore, materialized models."""
