"""Readers: raw logs in line order, file registries, label files, process counters."""
