"""Readers that turn tables and sequence files into collections: (seq_id long, name string, seq string)."""

from ringloom.sources.collection import check_strict, concat, from_table, spread, with_starts
from ringloom.sources.fasta import read_fasta, read_fastq, read_sequences

__all__ = ["check_strict", "concat", "from_table", "read_fasta", "read_fastq", "read_sequences", "spread", "with_starts"]
