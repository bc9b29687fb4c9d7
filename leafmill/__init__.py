"""leafmill: document retrieval and text data processing as Spark DataFrame plans."""
