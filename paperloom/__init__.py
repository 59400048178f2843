"""paperloom: document analytics and retrieval as Spark plans."""
