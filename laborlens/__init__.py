"""Labor-market analytics over job postings, as DataFrame operators."""
