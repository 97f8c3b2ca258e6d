"""Driver-side planning over query graphs: trees, cores, nuclei, matching orders, symmetry breaking."""
