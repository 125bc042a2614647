"""drafthorse: analytics over drawing pages and text corpora, declared as Spark DataFrame plans."""
