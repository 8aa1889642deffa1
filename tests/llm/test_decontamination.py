import hashlib
import random
import re

from driftline.llm.decontamination import contamination, contamination_digest

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, window string"
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, window):
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[i:i + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, found = words(text), set(), set()
        for gram, ids in wins.items():
            for i in range(len(w) - len(gram) + 1):
                if tuple(w[i:i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= ids
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(
            ",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items, **kwargs):
    frame = contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS),
                          **kwargs)
    return sorted(map(tuple, contamination_digest(frame).collect()), key=str)


def test_equals_brute_force_with_overlaps_short_items_and_nulls(spark):
    rng = random.Random(3)
    vocabulary = ["a", "B", "c", "É", "é", "İx", "ab1", "\U0001F600"]
    phrase = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, phrase(rng.randint(1, 7))) for i in range(14)]
    items += [(20, "c"), (21, None), (22, "..!"), (None, "a B"), (3, "B c B"), (3, "B c B")]
    docs = [(i, phrase(rng.randint(0, 40)) + rng.choice([".", ",\n", ""]), "x")
            for i in range(40)]
    docs += [(7, None, None), (8, "", None), (9, "a-B_c", None), (9, "a-B_c", None),
             (None, "C c", "y"), (50, "É " * 30_000 + "a b ab1", "y")]
    assert run(spark, docs, items, window=4, shingle=3, bits=64) == brute(docs, items, 4)
    assert run(spark, docs, items, window=2, shingle=3, bits=1024) == brute(docs, items, 2)


def test_empty_benchmark_and_empty_table(spark):
    docs = [(1, "a b", "x"), (2, None, "x")]
    assert run(spark, docs, []) == brute(docs, [], 10)
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, docs, [(1, "a b")]) == brute(docs, [(1, "a b")], 10)


def test_hot_item_in_a_third_of_the_rows(spark):
    item = "one two three four five six seven eight nine ten eleven"
    docs = [(i, f"start {item} end" if i % 3 == 0 else f"other text {i}", None)
            for i in range(600)]
    rows = run(spark, docs, [(5, item), (6, item)])
    assert rows == brute(docs, [(5, item), (6, item)], 10)
    assert sum(r[5] for r in rows) == 200


def test_capital_sigma_before_a_break(spark):
    item = "ΟΔΟΣ.ΑΒ ένα δύο ΤΡΙΣ'Α τέσσερα πέντε έξι ΕΠΤΑΣ:Β"
    docs = [(1, f"αρχή {item} τέλος", None), (2, item.replace(".", " "), None), (3, "ΟΔΟΣ", None)]
    items = [(1, item), (2, "ΟΔΟΣ")]
    rows = run(spark, docs, items, window=4)
    assert rows == brute(docs, items, 4)
    assert all(r[5] for r in rows)
