"""Column expressions over ledger text: dates, months and money. All of them run in the JVM."""
