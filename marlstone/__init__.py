"""marlstone: document search, graph, memory and corpus work as Spark DataFrames."""
