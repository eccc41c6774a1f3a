"""specweave: Spark-native analytics over requirement documents and their dependency graphs."""
