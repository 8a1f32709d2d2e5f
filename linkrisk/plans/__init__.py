"""Jobs and registered queries, composed of operators."""
