"""callsheet: reporting operators over dialogue-like event tables, on Spark."""
