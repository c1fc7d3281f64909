"""What a caller asks for: the ingest job and the reports, composed of the operators."""
