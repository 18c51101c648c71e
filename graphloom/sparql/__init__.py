"""SPARQL 1.1 queries, compiled to DataFrames."""
