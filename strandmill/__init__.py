"""A k-mer search engine on Spark: Bloom-filter bit slices as a Parquet index, queries as DataFrame plans."""
