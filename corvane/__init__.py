"""Decision-corpus analytics as Spark plans."""
