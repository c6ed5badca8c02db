"""Rule-corpus engine on Spark."""
