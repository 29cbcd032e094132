"""Registered queries: thin compositions of operators over named tables, each with its SQL where there is one."""
