"""Collection algebra on Spark: bags, sets, relations, sparse maps, sequences and graphs as DataFrames."""
