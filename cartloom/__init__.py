"""cartloom: commerce analytics and data preparation as Spark plans."""
