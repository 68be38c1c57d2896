"""Registered queries of the core library and the SQL that must give the same rows."""
