"""cutline: admission-cutoff analytics as Spark DataFrame plans."""
