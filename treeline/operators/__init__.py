"""Relational operators of a repository digest.  Each takes DataFrames and returns one, without actions of its
own unless it says so."""
