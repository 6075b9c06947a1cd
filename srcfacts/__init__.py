"""srcfacts: analytics over facts about source code and program traces, as Spark DataFrames."""
