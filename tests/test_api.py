import pytest

from marlstone.operators import store
from marlstone.plans import api


def test_handlers(spark):
    registry = store.Registry(spark).bootstrap()
    registry.put("docs", spark.createDataFrame([("1", "one word", ["a"]), ("2", "two words", ["a", "b"])], "_key string, content string, tags array<string>"))
    assert [r["_key"] for r in api.handle(registry, "bm25", collection="docs", query="two", min_score=0.0).collect()] == ["2"]
    assert [r["_key"] for r in api.handle(registry, "tags", collection="docs", tags=["a", "b"], tag_operator="AND").collect()] == ["2"]
    api.handle(registry, "document_delete", collection="docs", key="1")
    assert api.handle(registry, "document_query", collection="docs").count() == 1
    api.handle(registry, "glossary_add", term="Word", definition="d")
    assert api.handle(registry, "glossary_list").first().term == "Word"
    for bad in ({"limit": 0}, {"limit": 5000}):
        with pytest.raises(ValueError):
            api.handle(registry, "document_query", collection="docs", **bad)
    with pytest.raises(ValueError):
        api.handle(registry, "no such thing")
    assert api.envelope(registry.collections["docs"], "q", "bm25")["total"].first().total == 1
