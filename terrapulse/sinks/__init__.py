"""Writers. Unlike operators, these run jobs."""
