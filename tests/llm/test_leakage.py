import random
import re
import unicodedata

from conftest import rows
from depweft.llm import leakage as k

WORDS = [f"w{i}" for i in range(60)] + ["the", "of", "Straße", "naïve", "ﬁne", "Ελλάδα"]
SCHEMA_D = "doc_id bigint, text string, item_id string"
SCHEMA_I = "item_id bigint, suite string, lang string, text string, doc_id string"


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, "clash") for i, t in docs], SCHEMA_D)
    e = spark.createDataFrame([(i, "s", lang, t, "clash") for i, lang, t in items], SCHEMA_I)
    return rows(k.leaked_items(d, e))


def letters(text):
    return re.sub(r"[\W_]+", "", k.folded(text))


def words(text):
    return re.findall(r"[^\W_]+", "".join(c for c in k.folded(text) if unicodedata.category(c) != "Cf"))


def plain(docs, items):
    """Every window of every item against every document."""
    out = set()
    for i, lang, t in items:
        for d, text in docs:
            if text is None or t is None:
                continue
            if lang in k.UNSPACED:
                s, doc = letters(t), letters(text)
                hit = any(s[n : n + 40] in doc for n in range(len(s) - 39))
            else:
                a, b = words(t), " " + " ".join(words(text)) + " "
                hit = any(" " + " ".join(a[n : n + 12]) + " " in b for n in range(len(a) - 11))
            if hit:
                out.add((d, i))
    return sorted(out, key=repr)


def test_against_all_windows(spark):
    rng = random.Random(5)
    items = [(i, "en", " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 40)))) for i in range(25)]
    docs = []
    for d in range(120):
        text = [rng.choice(WORDS) for _ in range(rng.randrange(0, 60))]
        if rng.random() < 0.6:
            w = items[rng.randrange(25)][2].split()
            n = rng.randrange(9, 16)
            a = rng.randrange(max(1, len(w) - n + 1))
            at = rng.randrange(len(text) + 1)
            text[at:at] = w[a : a + n]
        docs.append((d, rng.choice([" ", "\n", ", "]).join(text)))
    assert found(spark, docs, items) == plain(docs, items) != []


def test_characters(spark):
    rng = random.Random(6)
    alphabet = "天地玄黄宇宙洪荒日月盈昃"
    items = [(i, "zh", "".join(rng.choice(alphabet) for _ in range(60))) for i in range(6)]
    docs = [(d, "，".join(["开头", items[d % 6][2][5 : 5 + 37 + d % 6], "结尾"])) for d in range(24)]
    assert found(spark, docs, items) == plain(docs, items) != []


def test_forms_that_do_not_matter(spark):
    item = "Assume nine replicas; the key Cache.Mode may overrule any alias beyond STRASSE ten eleven"
    docs = [
        (1, "assume NINE replicas\nthe  key cache mode, may overrule any alias beyond straße!"),
        (2, "Assume nine repli­cas the key Cache.Mode may over​rule any alias beyond Ｓtrasse"),
        (3, "assume nine repli-\r\ncas the key cache.mode may overrule any alias beyond strasse"),
        (4, "assume nine replicas the key cache mode may overrule any"),
        (5, "xassume nine replicas the key cache mode may overrule any alias"),
        (6, "assume nine replicas the key cache mode may overrule any aliases"),
        (7, None), (8, ""), (9, "word " * 200_000 + "nine replicas the key cache mode may overrule any alias beyond strasse " + "word " * 10),
        (1, "assume NINE replicas the key cache mode may overrule any alias beyond straße"),
    ]
    out = found(spark, docs, [(1, "en", item), (2, "en", item), (3, "en", None), (4, "en", "too short"), (5, None, "")])
    assert sorted({d for d, _ in out}) == [1, 2, 3, 9]
    assert sorted({i for _, i in out}) == [1, 2]


def test_empty_and_portions(spark, monkeypatch):
    items = [(i, "en", " ".join(f"u{i}x{n}" for n in range(14))) for i in range(8)]
    docs = [(i, t) for i, _, t in items]
    assert found(spark, [], items) == [] and found(spark, docs, []) == []
    assert found(spark, docs, items) == [(i, i) for i in range(8)]


def test_hot_tokens_and_a_full_bit_table(spark, monkeypatch):
    """The salted join, and a bit table so small that every shingle passes: the join alone decides."""
    monkeypatch.setattr(k, "broadcast_if_small", lambda df: df)
    monkeypatch.setattr(k, "hot_keys", lambda counts, keys, n: counts.select(*keys).limit(3).collect())
    monkeypatch.setattr(k, "SLOT_BITS", (1, 1))
    rng = random.Random(9)
    items = [(i, "en", " ".join(rng.choice(WORDS) for _ in range(20))) for i in range(6)]
    docs = [(d, "start " + items[d % 6][2] + " end" if d % 3 else " ".join(rng.choice(WORDS) for _ in range(30))) for d in range(40)]
    assert found(spark, docs, items) == plain(docs, items) != []


def test_any_number_of_items_takes_two_passes_of_the_corpus(spark, monkeypatch):
    seen = []
    whole = k._texts
    monkeypatch.setattr(k, "_texts", lambda documents: seen.append(1) or whole(documents))
    items = [(i, "en", " ".join(f"u{i}x{n}" for n in range(14))) for i in range(300)]
    docs = [(i, t) for i, _, t in items[:50]]
    assert sorted(found(spark, docs, items)) == [(i, i) for i in range(50)]
    assert len(seen) == 2


def test_report(spark):
    leaks = spark.createDataFrame([(1, 5), (2, 5)], "doc_id bigint, item_id bigint")
    items = spark.createDataFrame([(5, "s", "en", ""), (6, "s", "en", "")], "item_id bigint, suite string, lang string, text string")
    assert rows(k.leak_report(leaks, items)) == [(5, "s", "en", 2), (6, "s", "en", 0)]


def test_prefix_is_the_rarest_shingle_of_each_window(spark):
    df = spark.createDataFrame([(1, "en", " ".join(f"a{n}" for n in range(14)))], "item_id bigint, lang string, text string")
    parts = k.item_shingles(df)
    all_h = [r["h"] for r in parts.orderBy("at").collect()]
    counts = lambda rare, n: spark.createDataFrame([(h, n if i == rare else 9) for i, h in enumerate(all_h)], "h bigint, n bigint")
    assert [r["at"] for r in k.prefix_tokens(parts, counts(4, 1)).collect()] == [4], "it lies in every window"
    assert k.prefix_tokens(parts, counts(4, 0)).count() == 0, "a window with a shingle that no document holds leaks nowhere"
    assert [r["at"] for r in k.prefix_tokens(parts, counts(0, 1)).filter("n = 1").collect()] == [0]


def test_positions_leave_room():
    """The bound is safe: it never exceeds the letters of the smallest window of the item around the token."""
    item = " ".join("x" * (1 + n % 5) for n in range(30))
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([item]), pa.array([True])], names=["a", "b", "c"])
    sizes = [1 + n % 5 for n in range(30)]
    for r in next(iter(k._item_rows([batch]))).to_pylist():
        around = [sum(sizes[i : i + 12]) for i in range(max(0, r["at"] - 8), min(r["at"], 18) + 1)]
        assert r["need"] == min(around) and r["before"] == sum(sizes[max(0, r["at"] - 8) : r["at"]])
