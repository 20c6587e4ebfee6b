"""Registered queries: each a function of (session, folder of tables) and, where SQL can express it, the SQL that it equals."""
