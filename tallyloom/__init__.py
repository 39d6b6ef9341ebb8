"""tallyloom: a PySpark-native engine that turns report tables and pages into one audited set of facts."""
