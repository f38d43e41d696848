"""ledgerloom: message-to-ledger analytics as Spark DataFrame jobs."""
