import __spark_entry__ as entry
from lodestone.queries import ALL

#: The query whose result SQL can't give, for want of its hash.
WITHOUT_SQL = {"hash_embedding_blake2b"}


def test_every_query_has_sql():
    assert {name for name, (_, sql) in ALL.items() if sql is None} == WITHOUT_SQL
    assert set(ALL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
