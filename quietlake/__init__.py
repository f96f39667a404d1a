"""quietlake: a Spark-native engine for privacy masking, public memory and dialogue analytics."""
