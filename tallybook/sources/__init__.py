"""Where ledgers come from and go to: CSV exports, combined files, the stored table, SQL views."""
