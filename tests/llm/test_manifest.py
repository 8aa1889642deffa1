import hashlib
import zlib

import pytest

from driftline.llm import manifest

DDL = "lang string, doc_id long, source string, n_chars int, text string, leaf string, rank int"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    values = (row[f] for f in manifest.FIELDS)
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def climbed(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i:i + 8]) for i in range(0, len(last), 8)])
    return levels


def siblings(levels, at):
    found = []
    for level in levels[:-1]:
        low = at // 8 * 8
        found.append((level[low:at], level[at + 1:low + 8]))
        at //= 8
    return found


def brute_force(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    mine = {lang: sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), n)
                          for n, r in enumerate(rows) if r["lang"] == lang)) for lang in langs}
    trees = {lang: climbed([m[2] for m in mine[lang]]) for lang in langs}
    top = climbed([trees[lang][-1][0] for lang in langs])
    out = []
    for place, lang in enumerate(langs):
        for at, (_, _, leaf, n) in enumerate(mine[lang]):
            row, proof = dict(rows[n]), siblings(trees[lang], at) + siblings(top, place)
            key = row["doc_id"]
            if key is not None and zlib.crc32(str(key).encode()) % 3 == 0 and row["text"]:
                row["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in row["text"])
            folded = leaf_of(row)
            for left, right in proof:
                folded = digest(*left, folded, *right)
            out.append((key, leaf, trees[lang][-1][0], top[-1][0],
                        digest(*[d for a, b in proof for d in a + b]), folded,
                        folded == top[-1][0]))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame(rows, DDL)
    got = [tuple(r) for r in manifest.tamper_check(docs).collect()]
    assert sorted(got, key=repr) == brute_force([r.asDict() for r in docs.collect()])


@pytest.mark.parametrize("levels", [1, 4])
def test_hot_language_nulls_ties_and_repeated_rows(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    rows = [("en", i * 7 % 601 - 5, "web", i, f"Text ÄÖ {i}" * (i % 5), "x", 0) for i in range(600)]
    rows += [(None, i, None, None, None if i % 2 else "", "x", 1) for i in range(9)]
    rows += [("", None, "s", 1, "A", None, None)] * 3 + [("en", 7, "web", 2, "B", "y", 2)] * 10
    rows += [("de", 1, "s", 1, "Einzeln " * 20000, None, 3)]
    check(spark, rows)


def test_many_languages(spark, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", 1)
    check(spark, [(f"l{i % 70}", i, "s", i, f"T{i}", None, None) for i in range(90)])


def test_one_row_and_none(spark):
    check(spark, [("en", 3, "s", 1, "Only", None, None)])
    assert manifest.tamper_check(spark.createDataFrame([], DDL)).count() == 0


def test_any_changed_field_breaks_the_proof(spark):
    docs = spark.createDataFrame(
        [("en", i, "s", i, f"T{i}", None, None) for i in range(20)], DDL)
    found = manifest.merkle_manifest(docs, other=manifest.row_digest(manifest.F.lit("z")))
    wrong = found.select(manifest.folded(manifest.F.col("other"), manifest.F.col("proof")).alias(
        "at"), manifest.as_text(manifest.F.col("root")).alias("root"))
    assert wrong.where("at = root").count() == 0
