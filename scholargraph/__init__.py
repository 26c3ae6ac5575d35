"""scholargraph: batch analytics over scholarly metadata and citation graphs on Spark."""
