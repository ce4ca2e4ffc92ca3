"""Plans of the inspection dataflow."""
