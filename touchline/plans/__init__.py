"""Bridge views over the star schema, and the registered queries."""
