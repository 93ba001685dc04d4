"""DataFrame operators on reads, k-mer graphs, cycles and arrays."""
