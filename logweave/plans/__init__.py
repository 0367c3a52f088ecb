"""Query plans: the registered query catalog, its DuckDB statements and the
end-to-end benchmark plan."""
