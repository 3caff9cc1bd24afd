"""Operations analytics for a fleet of relational databases, on Spark DataFrames."""
