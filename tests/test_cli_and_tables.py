from codewell.__main__ import loop
from codewell.api import SearchResult
from codewell.sources import schemas


class Fake:
    def search(self, query, top_k):
        return [SearchResult("1", "letra", 0.5, {"title": query, "artist": "a"})] if query != "none" else []


def test_loop():
    assert list(loop(Fake(), ["dog\n", "  \n", "none\n", "EXIT\n", "cat\n"])) == ["1. 0.5000  dog - a", "no result"]


def test_tables(spark, tmp_path):
    for statement in schemas.create_statements(str(tmp_path)):
        spark.sql(statement)
    try:
        for name, ddl in schemas.RELATIONS.items():
            assert spark.table(name).count() == 0 and len(spark.table(name).columns) == len(schemas._split(ddl))
    finally:
        for name in schemas.RELATIONS:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
