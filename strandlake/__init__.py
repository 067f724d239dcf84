"""strandlake: short-read (FASTA/FASTQ) analytics on Spark DataFrames."""
