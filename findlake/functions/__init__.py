"""findlake subpackage."""
