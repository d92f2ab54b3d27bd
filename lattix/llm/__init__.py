"""Training-data operators: filtering, de-duplication, scanning and mixing of document corpora."""
