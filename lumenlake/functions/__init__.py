"""Engine-side expression builders (pure Columns)."""
