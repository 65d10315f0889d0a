"""Operators: encoders, smoothing, densities, classifiers, clusterers, mixtures, neighbours, sequences, networks."""
