"""Filter audit and phrase mining against brute force, with odd rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyspark
from pyspark.sql import functions as F

from aerolith.llm import filter_audit, phrases
from aerolith.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import duck_rows, spark_rows

DOCS = "doc_id long, text string, lang string, source string"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text):
    for c in SPACES[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_audit(rows, labels):
    first = {}
    for i, text, _, _ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    good, toxic = defaultdict(int), defaultdict(int)
    for i, q, t in labels:
        good[i] |= q == 1
        toxic[i] |= t == 1
    fails = []
    for i, text, _, source in rows:
        text = text or ""
        w = words_of(text)
        f = {c for c, hit in (("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * sum("A" <= x <= "Z" for x in text) > 2 * len(text)), ("D", any(x in "#$%&*|" for x in text)), ("E", i is not None and first[text] < i)) if hit}
        fails.append((source or "", f, i is not None and good[i], i is not None and toxic[i]))
    out = []
    for part in {p for p, *_ in fails}:
        own = [x for x in fails if x[0] == part]
        orders = ["".join(o) for o in permutations("ABCDE")]
        removed = Counter()
        lines = []
        for order in orders:
            left = own
            for step, c in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                removed[c] += len(gone)
                lines.append((c, part, order, step, len(left), len(gone), sum(c in x[1] and bool(x[1] & before) for x in own), sum(x[1] == {c} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)))
        out += [(*line[1:], removed[line[0]]) for line in lines]
    return sorted(out)


def odd_documents():
    long = " ".join(f"w{i}" for i in range(250))
    texts = [None, "", "  \t ", long, long, long.upper(), "a b " * 150, "word\x0bword word", "$5", "Ünï ÅÄ É", "X" * 3, long + " #", "é" * 10 + "A", "w" * 100_000, long * 40]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(texts)]
    rows += [(3, long, "en", "s0"), (3, long, "en", None), (2, long, None, ""), (None, long, "en", "s1"), (None, long, "en", "s1"), (None, None, None, None)]
    return rows


def test_audit_equals_brute_force_on_odd_rows(spark):
    rows = odd_documents()
    labels = [(0, 1, 0), (3, 1, None), (3, 0, 1), (6, None, 1), (8, 1, 1), (None, 1, 1), (99, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("clash") for c in ("word", "n", "mask", "h", "part", "good", "first", "words")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("n", F.lit("clash"))
    got = sorted(tuple(r) for r in filter_audit.audit(docs, marks).collect())
    assert got == brute_audit(rows, labels)


def test_audit_of_no_rows(spark):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels).count() == 0
    some = spark.createDataFrame([(1, "a b", "en", "x")], DOCS)
    got = filter_audit.audit(some, labels).where("filter_order = 'ABCDE' and step = 1").head()
    assert tuple(got) == ("x", "ABCDE", 1, 0, 1, 0, 1, 0, 0, 120)


def test_audit_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(QUERIES["op11_filter_audit"](spark, folder)) == duck_rows(ORACLE_SQL["op11_filter_audit"], folder)


def brute_phrases(rows, least, most=2000):
    n, f = Counter(), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for _, text, lang, _ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3):
                f.update((lang or "und", *w[i : i + k]) for i in range(len(w) - k + 1))
    found = {}
    for p, a in f.items():
        if len(p) > 2 and a >= least:
            longer = [b for q, b in f.items() if len(q) == 4 and len(p) == 3 and q[0] == p[0] and p[1:] in (q[1:3], q[2:4]) and b >= least]
            if not any(100 * b >= 50 * a for b in longer):
                cuts = []
                for k in range(1, len(p) - 1):
                    left, right = f[p[: k + 1]], f[(p[0], *p[k + 1 :])]
                    cuts.append((10**6 * a * a // (left * right), k, left, right))
                score, _, left, right = min(cuts)
                found.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, rank, p.decode(), -a, x, y, n[lang], -s) for lang, all_ in found.items() for rank, (s, a, p, x, y) in enumerate(sorted(all_)[:most], 1))


def phrase_documents():
    texts = [None, "", " \t ", "...!!", "a", "The CAT sat. The cat, the cat sat on", "the cat sat " * 9, "ÄB äb Äb äb", "x\x0by x\x0cy x\ty x y", "n n n n n n", "new york city " * 7 + "new york", "w" * 90_000 + " the cat", "a\u00a0b c\u00a0d " * 5]
    rows = [(i, t, ("en", "de", None, "und")[i % 4], "s") for i, t in enumerate(texts * 3)]
    return rows + [(5, texts[6], "en", "s")] * 3


def test_phrases_equal_brute_force_on_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK_BYTES", 200)
    rows = phrase_documents()
    docs = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit("clash") for c in ("block", "n", "a", "phrase", "words", "codes", "rank")})
    for least, most in ((2, 2000), (4, 3)):
        got = sorted(tuple(r) for r in phrases.collocations(docs, least, most).collect())
        assert got == brute_phrases(rows, least, most) and got


def test_positions_come_back():
    for at in ([], [0], [7, 3, 900_000, 2, 2**31 - 1, 0]):
        assert phrases.unpacked(phrases.packed(np.array(at, dtype=np.int32))).tolist() == at


def test_slices_of_a_block_are_cut_one_by_one(spark, monkeypatch):
    sizes, cut = [], phrases.positioned
    monkeypatch.setattr(phrases, "positioned", lambda texts: sizes.append(sum(len(t.as_py()) for t in texts)) or cut(texts))
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    texts = [f"a word{i % 50} of text {i}, and more. " * 300 for i in range(600)]
    index = phrases.vertical_lists(SimpleNamespace(mapInArrow=lambda f, _: f))
    blocks = list(index(iter([pa.RecordBatch.from_arrays([pa.array(["en"] * 600), pa.array(texts)], ["lang", "text"])])))
    assert len(blocks) == 1 and max(sizes) <= 1_000_000 < sum(sizes)
    words, at = cut(pa.array(texts))
    n, code = blocks[0].column("counts")[0].as_py(), words.dictionary_encode().indices.to_numpy()
    found = phrases.unpacked(blocks[0].column("positions")[0].as_py())
    order = np.argsort(code, kind="stable")
    assert blocks[0].column("words")[0].as_py() == words.dictionary_encode().dictionary.to_pylist() and n == np.bincount(code).tolist()
    assert np.array_equal(np.diff(np.sort(found)) == 1, np.diff(at) == 1) and np.array_equal(np.argsort(found), np.argsort(at[order]))


def test_phrases_of_no_rows_and_of_few(spark):
    docs = spark.createDataFrame([], DOCS)
    assert phrases.collocations(docs).count() == 0
    assert phrases.collocations(spark.createDataFrame([(1, "a b", "en", "s"), (2, None, None, None)], DOCS)).count() == 0


def test_scores_of_large_counts_are_exact(spark):
    big = 9 * 10**14
    one = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, phrase string, a long")
    two = spark.createDataFrame([("en", "a b", big - 3)], "lang string, phrase string, a long")
    assert phrases.cut_scores(two, one, 2).head()["score"] == 10**6 * (big - 3) ** 2 // ((big + 7) * (big + 1))


def test_phrases_equal_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert spark_rows(QUERIES["op12_phrases"](spark, folder)) == duck_rows(ORACLE_SQL["op12_phrases"], folder)
