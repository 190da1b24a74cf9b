"""Fleet configuration analytics and corpus preparation as Spark plans."""
