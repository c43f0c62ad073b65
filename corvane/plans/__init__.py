"""Front-end planning: SQL with ``similar(...)``, path queries, and the catalogue of registered queries."""
