"""foldline: discrete structural alphabets as Spark plans."""
