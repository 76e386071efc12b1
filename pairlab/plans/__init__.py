"""Plans: operators composed into jobs, and their bindings to the test tables."""
