"""loomgraph subpackage."""
