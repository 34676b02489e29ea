"""lodestone: retrieval and document analytics as DataFrame operators on Spark."""
