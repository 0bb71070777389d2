"""Readers and writers (S1-S12): tables, CSV, checkpoints, run log, file discovery."""
