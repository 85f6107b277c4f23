"""Queries over the given tables, each with equivalent SQL where SQL can say it."""

from bindings import checks, knowledge, large, lexical, models, normal, sounds, streams, upkeep
from bindings.upkeep_sql import SQL

upkeep.SQL = SQL
MODULES = [lexical, models, normal, sounds, knowledge, checks, upkeep, large, streams]
