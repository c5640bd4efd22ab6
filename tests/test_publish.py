"""The published index keeps vectors and records together."""

from recordlens.sources.store import load_index
from workload import catalog


def test_published_vectors_come_back(spark, tables, monkeypatch):
    real, bases = catalog.publish_index, []

    def publish(index, base):
        bases.append(base)
        return real(index, base)

    monkeypatch.setattr(catalog, "publish_index", publish)
    assert catalog.publish_snapshot(spark, tables).count() > 0
    names = ["work_item_id", "title", "fingerprint", "embedding"]
    back = load_index(spark, bases[0]).select(*names).collect()
    built = catalog._hash_index(spark, tables).select(*names).collect()
    assert sorted(back) == sorted(built) and any(any(r.embedding) for r in back)
