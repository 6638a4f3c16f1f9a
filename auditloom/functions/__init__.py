"""Column builders: time, record fields, command-line normalisation, categories."""
