"""keyloom: a Spark-native engine for auditing localization keys."""
