"""Sources of the inspection dataflow."""
