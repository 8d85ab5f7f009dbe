"""helixframe: long-read structural-variation analytics, declared as Spark plans."""
