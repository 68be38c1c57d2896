"""Property-graph and conversation-memory analytics written as Spark DataFrame plans."""
