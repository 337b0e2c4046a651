"""Office and PDF documents as tables and as Markdown, on Spark."""
