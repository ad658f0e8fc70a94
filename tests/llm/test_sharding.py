from tidemark.llm.sharding import MULTIPLIER, shard


def jump(key, n):
    """The published algorithm, number by number."""
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_published_algorithm(spark, documents):
    import hashlib

    found = shard(documents([(i, "t") for i in range(300)]), shards=8).collect()
    for r in found:
        key = int(hashlib.md5(str(r["doc_id"]).encode()).hexdigest()[:16], 16)
        assert (r["shard"], r["grown_shard"]) == (jump(key, 8), jump(key, 9))
        assert r["grown_shard"] in (r["shard"], 8)


def test_odd_rows(spark, documents, odd):
    found = shard(documents(odd), shards=3, carry=True)
    assert found.count() == len(odd) and "lang" in found.columns
    rows = found.collect()
    for s in range(3):
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert all((r["size"], r["text_crc32"]) == (1, 0) for r in empty)
    assert shard(documents([])).count() == 0
