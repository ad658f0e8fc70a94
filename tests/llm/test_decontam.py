import random
import re

from tidemark.llm.decontam import decontaminate, leaks


def multiset(words, k):
    out = {}
    for i in range(len(words) - k + 1):
        s = tuple(words[i : i + k])
        out[s] = out.get(s, 0) + 1
    return out


def brute(docs, items):
    """Every window of the item's size at every place."""
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for m, text in items:
            b = (text or "").lower().split()
            k = min(5, len(b))
            if not k:
                continue
            item = multiset(b, k)
            for p in range(max(0, len(w) - k + 1)):
                window = multiset(w[p : p + len(b)], k)
                common = sum(min(n, item.get(s, 0)) for s, n in window.items())
                total = sum(window.values()) + sum(item.values()) - common
                if 100 * common >= 75 * total and common / total > out.get((d, m), 0):
                    out[d, m] = common / total
    return out


def test_planted_leaks(spark, documents, odd):
    r = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(text(r.randint(8, 60)))) for i in range(12)] + [(20, "two words"), (21, None), (22, ""), (23, "a b a b a b a b a b a b")]
    docs = list(odd)
    for i in range(60):
        body = items[i % 12][1].split()
        for _ in range(i // 20):  # none, one or two words changed
            body[r.randrange(len(body))] = r.choice(words)
        docs.append((100 + i, " ".join(text(30) + [x.upper() for x in body] + text(30))))
    docs += [(300, "here two words"), (301, "two\twords"), (302, "x a b a b a b a b a b a b"), (303, "a b a b a b")]
    table = spark.createDataFrame(items, "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): x["similarity"] for x in leaks(documents(docs), table).collect()}
    expected = brute(docs, items)
    assert found.keys() == expected.keys() and all(abs(found[k] - v) < 1e-12 for k, v in expected.items())
    rest = decontaminate(documents(docs), table)
    assert rest.count() == sum(d not in {k[0] for k in expected} for d, _ in docs) and rest.columns == documents([]).columns


def test_empty(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert leaks(documents([(1, "a b")]), none).count() == 0 and decontaminate(documents([(1, "a b")]), none).count() == 1
    assert leaks(documents([]), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_items_of_any_length(spark, documents):
    """More shingles than counters of 16 bits hold, repeated ones among them."""
    r = random.Random(7)
    body = [f"w{r.randint(0, 40_000)}" for _ in range(33_000)]
    docs = [(1, " ".join(["before", *body[:24_770]])), (2, " ".join(body[:20_000])), (3, "x y " * 12_451)]
    items = spark.createDataFrame([(1, " ".join(body)), (2, "x y " * 16_600)], "item_id long, text string")
    found = {(x["doc_id"], x["item_id"]): (x["similarity"], x["position"]) for x in leaks(documents(docs), items).collect()}
    assert found == {(1, 1): (24_766 / 32_996, 1), (3, 2): (24_898 / 33_196, 0)}


def test_a_large_benchmark(spark, documents):
    """More shingles than the sifting table once had room for; items share templates."""
    r = random.Random(8)
    items = [(i, f"which of the following is true of {' '.join(f'v{r.randint(0, 5000)}' for _ in range(8))}") for i in range(20_000)]
    docs = [(i, f"intro words {items[i * 37][1]} and more words") for i in range(200)] + [(1000 + i, "which of the following is true of it") for i in range(50)]
    found = leaks(documents(docs), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id").collect()
    assert {(x["doc_id"], x["item_id"]) for x in found} >= {(i, i * 37) for i in range(200)} and all(x["doc_id"] < 1000 for x in found)


def test_columns_of_inner_names(spark, documents):
    from pyspark.sql import functions as F

    docs = documents([(1, "a b c d e f g"), (2, "none of it")])
    for name in ("leak_id", "leak_hash", "text_hash", "shingles", "words", "at", "window", "item_row", "mark", "run"):
        docs = docs.withColumn(name, F.lit(7))
    rest = decontaminate(docs, spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string"))
    assert rest.columns == docs.columns and [x["doc_id"] for x in rest.collect()] == [2]


def test_plans_do_not_write_out_the_table(spark, documents):
    """The driver keeps and logs every plan, so the table that sifts positions mustn't stand in it in hexadecimal."""
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:30])), (2, "a b c")], "item_id long, text string")
    found = leaks(documents([(1, " ".join(words)), (2, "x a b c y")]), items)
    assert sorted((r["doc_id"], r["item_id"], r["position"]) for r in found.collect()) == [(1, 1, 0), (2, 2, 1)]
    assert not re.search("0x[0-9A-Fa-f]{500}", found._jdf.queryExecution().simpleString())
