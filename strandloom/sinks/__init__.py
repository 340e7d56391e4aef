"""Writers: N-Triples in both layouts, tables, compression and decompression."""
