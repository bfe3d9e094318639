"""Column builders: strings, sequences, coordinates and arrays, all inside Catalyst."""
