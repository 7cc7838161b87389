"""Spark jobs over corpora of structured office documents."""
