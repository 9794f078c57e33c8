"""tidecrawl: web-corpus analytics as Spark plans."""
