"""Training-data operators over documents and conversations, written as Spark jobs."""
