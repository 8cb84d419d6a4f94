"""Jobs, derived frames and registered queries."""
