"""The tables that operators read and return.  Intervals are 0-based and half open."""

READS = "cell_id string, r1 string, r2 string, q1 string, q2 string, umi string"
FASTQ = "file_id string, ordinal long, name string, seq string, qual string"
CIGAR = "array<struct<op: string, len: int>>"
ALIGNMENTS = f"file_id string, ordinal long, qname string, flag int, chrom string, pos long, end_pos long, mapq int, cigar {CIGAR}, l_seq int, seq string, qual string"
FEATURES = "gene_id string, gene_name string, chrom string, start long, end long, strand string"
WHITELIST = "pool int, idx int, name string, seq string"
CELL_FILES = "cell_id string, file_name string, content binary"
COUNTS = "cell_id string, feature string, cnt long"
