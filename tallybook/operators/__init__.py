"""Operators over the typed ledger: lazy, and sorted only where the order is the result."""
