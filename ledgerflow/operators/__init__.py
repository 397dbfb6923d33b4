"""Operators over log, ledger, session, quorum, outbox, snapshot and history tables."""
