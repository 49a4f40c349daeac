"""factloom: a Spark-native analytics engine over immutable facts."""
