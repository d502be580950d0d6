"""Readers of FASTA, CSV, flat binary, TSV and run folders."""
