"""The operators on documents against brute force, on small tables with nulls, ties and odd texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from math import exp, log, log10

import numpy as np
import pytest

from aerolith.llm import exact_dedup, mixing, ngram_join, piece_sampling, sharding, suffix_tree_lm, token_files, toxicity
from aerolith.llm.queries import ORACLE_SQL, QUERIES, table, tokenizer_file
from tests.compare import duck_rows, spark_rows

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, digest int"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty " * 2


def odd_rows():
    near = BASE.replace("twenty", "TWENTY", 1)
    texts = ["", None, " \t\n ", BASE, near, BASE + "and more", "two words", "two  words", "x" * 5000, "naïve ▁ ünï \x01  <|endoftext|>   end", "tie a b c d e", "tie a b c d e", "a b c d e f g h " * 3000, BASE]
    rows = [(i, t, "en", [None, "web", "code", ""][i % 4], 0, "clash", 1) for i, t in enumerate(texts)]
    return rows + [(13, BASE, "en", "web", 0, "clash", 1), (None, BASE, None, None, None, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def real(spark):
    return table(spark, DATA, "documents")


def docs_of(df):
    return [(r["doc_id"], r["text"] or "", r["source"]) for r in df.select("doc_id", "text", "source").collect()]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, DATA)) == duck_rows(ORACLE_SQL[name], DATA)


# ------------------------------------------------------------------ exact dedup

def brute_dedup(rows):
    groups = defaultdict(list)
    for d, t, _ in rows:
        groups[t].append(d)
    out = []
    for d, t, _ in rows:
        ids = groups[t]
        keep = max((x for x in ids if x is not None), default=None) if len(ids) > 1 else d
        out.append((d, keep, len(ids), d == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_dedup_with_odd_rows(odd, none):
    got = exact_dedup.exact_dedup(odd).collect()
    assert sorted(map(tuple, got), key=repr) == brute_dedup(docs_of(odd))
    assert exact_dedup.exact_dedup(none).count() == 0
    stays = exact_dedup.deduplicated(odd)
    assert stays.columns == odd.columns
    assert Counter(r["text"] or "" for r in stays.collect()) == Counter({t for _, t, _ in docs_of(odd)})


def test_colliding_digests_are_told_apart_by_bytes(odd):
    from pyspark.sql import functions as F

    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1).cast("binary")
    rows = odd.where("doc_id is not null")
    got = exact_dedup.exact_dedup(rows, digest=weak).collect()
    assert sorted(map(tuple, got), key=repr) == brute_dedup(docs_of(rows))


def test_state_goes_on_after_a_restart(spark, odd, tmp_path):
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
    state = f"file://{tmp_path}/state"
    first, second = rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1")
    assert sorted(map(tuple, exact_dedup.exact_dedup(first, state=state).collect()), key=repr) == brute_dedup(docs_of(first))
    both = exact_dedup.exact_dedup(second, state=state).collect()
    assert sorted(map(tuple, both), key=repr) == brute_dedup(docs_of(rows))
    again = exact_dedup.exact_dedup(second.limit(0), state=state).collect()
    assert sorted(map(tuple, again), key=repr) == brute_dedup(docs_of(rows))


def test_columns_may_be_called_anything(odd):
    from pyspark.sql import functions as F

    names = ["sha", "keep", "_keep", "_sha", "_many", "_n", "key", "nth", "copies", "digest", "file", "at"]
    docs = odd.select("doc_id", "text", "source", *[F.lit(k).alias(c) for k, c in enumerate(names)])
    for out in (exact_dedup.deduplicated(docs), mixing.mixture(docs)):
        assert out.columns == docs.columns
        assert all(r[c] == k for r in out.collect() for k, c in enumerate(names))


# ------------------------------------------------------------------ suffix tree

def tokens(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())) + [b""]


def test_base_score_and_counts(spark, real):
    rows = docs_of(real)
    train = Counter()
    for d, t, _ in rows:
        if zlib.crc32(str(d).encode()) % 5 != 1:
            train.update(tokens(t))
    total, distinct = sum(train.values()), len(train)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(real).collect()}
    assert len(got) == len(rows)
    for d, t, _ in rows:
        w, r = tokens(t), got[d]
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 1)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(train[x] > 0 for x in w), total)
        assert r["base_score"] == pytest.approx(sum(log10((train[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w))
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_tree(rows, depth):
    """The tree in dictionaries: probability of a word after a context, and back-off of kept contexts."""
    texts = [tokens(t) for d, t, _ in rows if zlib.crc32(str(d).encode() if d is not None else b"") % 5 != 1]
    runs = [Counter(tuple(w[i : i + k + 1]) for w in texts for i in range(len(w) - k)) for k in range(depth + 1)]
    total, distinct = sum(runs[0].values()), len(runs[0])
    base = lambda w: (runs[0][(w,)] + 0.5) / (total + 0.5 * (distinct + 1))
    logp = {g: log(base(g[0])) for g, n in runs[0].items() if n > 1}
    kept, open_ = {}, {()}
    for k in range(1, depth + 1):
        by = defaultdict(dict)
        for g, n in runs[k].items():
            if n > 1 and g[:-1] in logp and g[1:] in logp and g[1:-1] in open_:
                by[g[:-1]][g[-1]] = n
        after, still = {}, set()
        for c, followers in by.items():
            t = runs[k - 1][c]
            left = max(1 - sum(n - suffix_tree_lm.DISCOUNT for n in followers.values()) / t, 1e-9)
            below = {w: logp[c[1:] + (w,)] for w in followers}
            less, gain = max(t - 1, 1), (t - sum(followers.values())) * log(left)
            for w, n in followers.items():
                gain += n * (log(max(n - 1 - suffix_tree_lm.DISCOUNT, 0) / less + max(left * t / less, 1e-9) * exp(below[w])) - below[w])
            for w, n in followers.items():
                after[c + (w,)] = log((n - suffix_tree_lm.DISCOUNT) / t + left * exp(below[w])) if gain >= suffix_tree_lm.GAIN else below[w]
            if gain >= suffix_tree_lm.GAIN:
                kept[c] = (log(left), {w: after[c + (w,)] for w in followers})
            if sum(n * -after[c + (w,)] for w, n in followers.items()) >= suffix_tree_lm.GAIN:
                still.add(c)
        logp, open_ = after, still
    return base, kept


def brute_logp(context, word, base, kept):
    """log of the word's probability: the longest kept context decides, what it lacks goes to the next."""
    if not context:
        return log(base(word))
    back, followers = kept.get(context, (0.0, {}))
    return followers[word] if word in followers else back + brute_logp(context[1:], word, base, kept)


def test_scores_equal_those_of_a_tree_in_dictionaries(real, odd):
    for docs, p_min in ((real, 1e-3), (odd, suffix_tree_lm.P_MIN)):
        rows = docs_of(docs)
        base, kept = brute_tree(rows, suffix_tree_lm.DEPTH)
        wanted = []
        for d, t, _ in rows:
            w = tokens(t)
            wanted.append((d, len(w), sum(brute_logp(tuple(w[max(0, i - suffix_tree_lm.DEPTH) : i]), w[i], base, kept) for i in range(len(w))) / log(10)))
        assert docs is odd or {len(c) for c in kept} >= {1, 2, 3}
        got = suffix_tree_lm.score(docs, p_min=p_min).collect()
        key = lambda r: (str(r[0]), r[1], r[2])
        for (d, n, s), (e, m, x) in zip(sorted(((r["doc_id"], r["n_tokens"], r["score"]) for r in got), key=key), sorted(wanted, key=key), strict=True):
            assert (d, n) == (e, m) and s == pytest.approx(x, rel=1e-9, abs=1e-6)


def test_next_word_distributions_sum_to_one(real):
    base, kept = brute_tree(docs_of(real), suffix_tree_lm.DEPTH)
    words = {w for d, t, _ in docs_of(real) if zlib.crc32(str(d).encode()) % 5 != 1 for w in tokens(t)}
    for c in sorted(kept, key=len)[:: max(1, len(kept) // 20)]:
        assert 0.97 < sum(exp(brute_logp(c, w, base, kept)) for w in words) <= 1.0 + 1e-6


def test_suffix_tree_with_odd_rows(odd, none):
    assert suffix_tree_lm.score(none).count() == 0
    rows = suffix_tree_lm.score(odd).collect()
    assert len(rows) == odd.count()  # ids that repeat or are null are rows of their own
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["n_tokens"] == 1 and got[1]["n_tokens"] == 1
    assert all(np.isfinite(r["score"]) and r["score"] <= 0 for r in got.values())


def test_rare_contexts_stay_in_the_tree_of_a_large_corpus(spark):
    # 21 million words, of which a pair occurs 4 times: fewer than 2^-22 of them
    few = [(i, "rare pair of words seen again " * 2) for i in (2, 6)]
    many = [(i, "a " * 50_000) for i in range(1_000, 1_530)]
    held = [i for i in range(7, 200) if zlib.crc32(str(i).encode()) % 5 == 1][:1]
    assert all(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in few)
    docs = spark.createDataFrame([*few, *many, (held[0], "rare pair of words seen again")], "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r for r in suffix_tree_lm.score(docs).collect()}[held[0]]
    assert got["train_tokens"] > 2**24 and got["score"] > got["base_score"] / 2


def test_pair_hash_is_that_of_spark(spark):
    rows = [(1, 2), (-5, 2**62), (0, -(2**63))]
    a, b = np.array(rows, dtype=np.int64).T.copy()
    assert suffix_tree_lm.pair_hash(a, b).tolist() == [r[0] for r in spark.createDataFrame(rows, "a long, b long").selectExpr("xxhash64(a, b)").collect()]


def test_runs_are_shuffled_in_few_bytes_and_come_back():
    rng = np.random.default_rng(8)
    words = np.minimum((1 / rng.random((3, 60_000))).astype(np.int64) * 7, 3_000_000)
    words[:, np.argsort(words[0])] = words.copy()
    words = words[:, np.argsort(words[0], kind="stable")]
    words[1, :40], words[2, 7], words[0, 9] = rng.integers(-(2**63), 2**63, 40), -1, suffix_tree_lm.OTHER
    n = np.ones(60_000, dtype=np.int64)
    n[:3] = 254, 255, 2**40
    size, data = suffix_tree_lm.packed_runs(words, n)
    back, counts = suffix_tree_lm.unpacked_runs(data, size, 60_000, 3)
    assert back.tolist() == words.tolist() and counts.tolist() == n.tolist()
    assert len(data) < 8 * 60_000  # two hashes and a count took 20 bytes


def test_look_ups_are_shuffled_in_few_bytes_and_find_every_run():
    rng = np.random.default_rng(9)
    lm, m, parts = suffix_tree_lm, 200_000, 4
    rows = (1 << 33) + np.arange(4_000)
    g, place = rng.integers(-(2**63), 2**63, m), np.sort(rng.integers(0, 4_000, m))
    g[:9], place[:9] = 77, 0  # a run that one row holds nine times
    asked = lm.packed_look_ups(g, place, np.arange(m) < 9, rows, parts)
    assert sum(len(r[3]) + len(r[5]) for r in asked) < 10 * m  # a row of the join took some 15 bytes
    known = g[::2]
    held = lm.packed_values(np.append(known[known != 77], [77, 77]), np.arange((known != 77).sum() + 2) == (known != 77).sum(), np.append(np.full((known != 77).sum(), 0.25), [-3.0, -0.5]), parts)
    got = [lm.looked_up([r for r in asked + held if r[0] == k], -9.0) for k in range(parts)]
    n_known, lower, upper = (sum(x[i].sum() for x in got) for i in (1, 2, 3))
    assert (n_known, lower) == (9, -27.0) and upper == 0.25 * (known != 77).sum() - 9 * 3.5
    row, n, lower, upper = (np.concatenate([lm.looked_up([r for r in asked if r[0] == k], -9.0)[i] for k in range(parts)]) for i in range(4))
    assert (row.tolist(), n.tolist(), lower.tolist(), upper.tolist()) == ([1 << 33], [0], [-81.0], [-81.0])


def test_levels_of_the_tree_are_few_records_and_no_joined_rows(real):
    lm = suffix_tree_lm
    _, nodes, alive, total, distinct, parts = lm.tree(real.selectExpr("doc_id", "coalesce(text, '') text"), lm.DEPTH)
    base, kept = brute_tree(docs_of(real), lm.DEPTH)
    records = nodes.collect()
    got = [(r["kind"], *lm.unpacked_nodes(r["data"], r["m"])) for r in records]
    assert sum(r["m"] for r in records if r["kind"] == lm.WORD) == distinct
    # one row for each node met in sorted joins before, which filled the executors' memory
    assert len(records) < min(sum(r["m"] for r in records) / 3, 3 * (lm.DEPTH + 1) * parts * (parts + 1))
    backs = np.sort(np.concatenate([v for kind, *_, v in got if kind == lm.CONTEXT]))
    assert np.allclose(backs[backs != 0], np.sort([b / log(10) for b, _ in kept.values()]), rtol=1e-9)
    for kind, g, n, *_ in got:
        assert (np.diff(g) > 0).all()
        assert kind == lm.GAINS or lm.in_filter(alive, g[n >= 2]).all()


def test_ranges_without_nodes_give_no_records():
    none = np.zeros(0, dtype=np.int64)
    assert list(suffix_tree_lm.by_part(none, 4)) == []
    assert suffix_tree_lm.packed_nodes(suffix_tree_lm.CONTEXT, none, none, none, none, none, 4) == []


def test_words_without_a_number_score_the_same(real, monkeypatch):
    key = lambda r: r["doc_id"]
    numbered = sorted(suffix_tree_lm.score(real).collect(), key=key)
    monkeypatch.setattr(suffix_tree_lm, "P_MIN", 1e-3)
    for a, b in zip(numbered, sorted(suffix_tree_lm.score(real, p_min=1e-3).collect(), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


# ------------------------------------------------------------------ mixing

def test_mixing_nears_its_targets(odd, real, none):
    assert mixing.mixed(none).count() == 0
    for docs in (odd, real):
        rows = mixing.mixed(docs).collect()
        assert rows and all(r["taken"] <= 3 * r["size"] for r in rows)
        assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mixed(docs).collect()), key=repr)
    source = {d: s for d, _, s in docs_of(real)}
    by = defaultdict(list)
    for r in mixing.mixed(real).collect():
        by[source[r["doc_id"]]].append(r)
    targets = {s: x[0]["target"] for s, x in by.items()}
    assert sum(targets.values()) == pytest.approx(sum(r["size"] for x in by.values() for r in x))
    for s, x in by.items():
        assert abs(sum(r["taken"] for r in x) - targets[s]) <= max(r["size"] for r in x)


def test_larger_budgets_take_supersets(real):
    few = {r["doc_id"]: r["copies"] for r in mixing.mixed(real, budget=0.3).collect()}
    many = {r["doc_id"]: r["copies"] for r in mixing.mixed(real, budget=0.6).collect()}
    assert all(many[d] >= n for d, n in few.items())


def test_mixture_repeats_rows(real):
    copies = {r["doc_id"]: r["copies"] for r in mixing.mixed(real).collect()}
    assert Counter(r["doc_id"] for r in mixing.mixture(real).collect()) == Counter({d: n for d, n in copies.items() if n})


# ------------------------------------------------------------------ n-gram join

def brute_components(rows, width, percent):
    sets = []
    for d, t, _ in rows:
        w = tokens(t)[:-1]
        k = min(width, len(w))
        sets.append((d, {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i))) for i, (d, s) in enumerate(sets)), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_ngram_components(real, width, percent):
    got = sorted(map(tuple, ngram_join.jaccard_classes(real, width, percent).collect()), key=repr)
    assert got == brute_components(docs_of(real), width, percent)


def test_ngram_join_of_one_large_group(spark):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):
        w = list(words)
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(60))] = f"v{rng.integers(1000)}"
        rows.append((i, " ".join(w), "s"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, ngram_join.jaccard_classes(docs).collect()), key=repr)
    assert got == brute_components(rows, 4, 85)


def test_pivots_go_to_the_bands_and_not_members_to_the_pivots(spark):
    rng = np.random.default_rng(4)
    rows = [(s, d, int(rng.integers(40, 90)), d % 5, 200, d % 7) for s in range(3) for d in range(40)]
    long = spark.createDataFrame(rows, "s long, doc_id long, n int, i int, most int, label long")
    band = lambda n: int(log(n) / (log(100 / 85) * 1.000001))
    pivots = {}
    for s, d, n, i, most, label in rows:
        key = (s, band(n))
        pivots[key] = min(pivots.get(key, (99, 0, 0)), (i, d, label))
    wanted = Counter((min(d, p[1]), max(d, p[1])) for s, d, n, _, _, label in rows for p in (pivots.get((s, band(n))), pivots.get((s, band(n) + 1))) if p and p[2] != label)
    got = ngram_join.pivot_pairs(long, 0, 85)
    assert Counter(map(tuple, got.collect())) == wanted and wanted
    lines = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    under = [next(x for x in lines[k:] if "Relation" in x or "LogicalRDD" in x or "LocalRelation" in x) for k, x in enumerate(lines) if "Generate" in x]
    assert under and all("band" in x for x in under)  # of pivots, which alone have a band in their table


def test_members_that_are_left_are_not_repeated_for_the_sizes_they_allow(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in range(3):
        for d in range(60):
            n = int(rng.integers(1, 130))
            i = int(rng.integers(0, n - -(-85 * n // 100) + 1))
            rows.append((s, d, n, i, 185 * (n - i) // 85 - n, d % 7 if s else 0))
    named = spark.createDataFrame(rows, "s long, doc_id long, n int, i int, most int, label long")
    left, small, large = ngram_join.remaining(named, 85)
    assert left.count() == 120 and small.count() <= 120 and large.count() <= 120
    fine = lambda n: int(log(n) / (log(ngram_join.FINE) * 1.000001))
    lists = [[r for r in rows if r[0] == s] for s in (1, 2)]
    both = [(y, x) for some in lists for y in some for x in some]
    work = sum(y[2] <= y[4] and fine(max(-(-85 * x[2] // 100), 1)) <= fine(y[2]) <= fine(min(x[2], x[4])) for y, x in both)
    assert ngram_join.pairs_left(small, large) == work
    wanted = Counter((min(y[1], x[1]), max(y[1], x[1])) for y, x in both if (y[2], y[1]) < (x[2], x[1]) and x[2] <= y[4] and y[2] <= x[4] and y[5] != x[5])
    assert Counter(map(tuple, ngram_join.pairs_of_rest(small, large, 85).collect())) == wanted and wanted


def test_ngram_join_with_odd_rows(odd, none):
    rows = odd.dropDuplicates(["doc_id"]).where("doc_id is not null")
    assert sorted(map(tuple, ngram_join.jaccard_classes(rows).collect()), key=repr) == brute_components(docs_of(rows), 4, 85)
    assert ngram_join.jaccard_classes(odd).count() == odd.count()
    assert ngram_join.jaccard_classes(none).count() == 0
    assert ngram_join.one_of_each(odd, width=5, percent=80).columns == odd.columns


# ------------------------------------------------------------------ sharding

@pytest.mark.parametrize("which", ["odd", "real", "none"])
def test_shards_are_even_and_slots_gapless(request, which):
    docs = request.getfixturevalue(which)
    rows = sharding.balanced_shards(docs).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by[s]) for s in range(24)]
    assert set(by) <= set(range(24)) and max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_all_links_of_a_document_count(spark):
    # document 0 is linked with one other through hub a and with three through hub b
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(240)] + [(None, "text 0")], "doc_id long, text string")
    links = spark.createDataFrame([(0, "a"), (0, "b"), (1, "a"), (2, "b"), (3, "b"), (4, "b"), (None, "b"), (5, None), (6, "alone")], "doc_id long, hub string")
    rows = {r["doc_id"]: r for r in sharding.balanced_shards(docs, shards=4, links=links).collect()}
    assert len(rows) == 241 and len({rows[i]["shard"] for i in range(5)}) == 1
    assert all(rows[i]["hub"] is not None for i in range(5)) and rows[5]["hub"] is None and rows[6]["hub"] is None


def test_sharding_law_against_brute_force(real, odd):
    for docs in (real, odd):
        texts = Counter((d, t) for d, t, _ in docs_of(docs))
        rows = sharding.balanced_shards(docs).collect()
        quota = len(rows) // 24
        by = defaultdict(list)
        for d, t in texts.elements():
            by[d, len(t.encode()) + 8, zlib.crc32(t.encode())].append(t)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter({k: len(v) for k, v in by.items()})
        linked = Counter(r["shard"] for r in rows if r["hub"] is not None)
        assert max(linked.values(), default=0) <= quota + 1
        # pairs of equal texts in different shards, against those when every row stays where its hash puts it
        groups = defaultdict(list)
        for r in rows:
            groups[r["size"], r["text_crc32"]].append(r["shard"])
        cut = sum(len(g) * (len(g) - 1) // 2 - sum(n * (n - 1) // 2 for n in Counter(g).values()) for g in groups.values())
        pairs = sum(len(g) * (len(g) - 1) // 2 for g in groups.values())
        assert docs is odd or cut <= 0.1 * pairs


def test_linked_documents_move_together(spark):
    rows = [(i, f"text {i // 4 if i < 80 else i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    at = {r["doc_id"]: r["shard"] for r in sharding.balanced_shards(docs).collect()}
    together = sum(len({at[4 * g + k] for k in range(4)}) == 1 for g in range(20))
    assert together >= 15


def test_a_third_of_equal_texts_fills_its_shards(spark):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}") for i in range(960)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = Counter(r["shard"] for r in sharding.balanced_shards(docs).collect() if r["doc_id"] % 3 == 0)
    assert sum(held.values()) == 320 and len(held) == 8


# ------------------------------------------------------------------ token files

def test_elias_fano_round_trip():
    rng = np.random.default_rng(3)
    for n, top in ((0, 0), (1, 1), (5, 5), (1000, 1000), (3000, 10**7)):
        x = np.sort(rng.integers(0, top + 1, n))
        e = token_files.EliasFano.of(x, top)
        e, _ = token_files.EliasFano.load(e.dump(), 0)
        assert e.select(np.arange(n)).tolist() == x.tolist()
        assert [int(e.select(np.array([i]))[0]) for i in range(n)] == x.tolist()
        assert all(e.search(v) == np.searchsorted(x, v) for v in rng.integers(0, top + 1, 20).tolist())


def test_one_document_is_found_in_its_block(spark, odd, tmp_path):
    path = tokenizer_file("word_bpe_49k.json")
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(odd, path, out)
    every = {r["doc_id"]: [] for r in odd.collect()}
    for r in token_files.read_tokens(spark, out, with_ids=True).collect():
        every[r["doc_id"]].append(r["ids"])
    for d, wanted in every.items():
        if d is not None:
            assert sorted(r["ids"] for r in token_files.find_tokens(spark, out, d).collect()) == sorted(wanted)
    assert token_files.find_tokens(spark, out, 99).count() == 0


def test_a_doc_id_of_many_rows_is_dealt_over_files(spark, tmp_path):
    rows = [(7, f"text {i}") for i in range(300)] + [(-(2**62), "low"), (2**62, "high"), (None, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = f"file://{tmp_path}/tokens"
    token_files.write_tokens(docs, tokenizer_file("word_bpe_49k.json"), out)
    got = token_files.read_tokens(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, -(2**62)] + [7] * 300 + [2**62]
    assert spark.read.parquet(out).where("n_docs > 0").select("part").distinct().count() > 3


def test_tokenizers_without_words_encode_whole_texts():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    encoder = token_files.Encoder(path, 2)
    text = "A word, and  spaces\n"
    assert not encoder.by_words and token_files.Encoder(tokenizer_file("word_bpe_49k.json"), 2).by_stops
    assert np.frombuffer(encoder.encode([text.encode()])[0], "<u2").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("which", ["odd", "real", "none"])
def test_token_files_give_back_what_was_encoded(request, which):
    from tokenizers import Tokenizer

    docs = request.getfixturevalue(which)
    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = sorted(((d, [*t.encode(x, add_special_tokens=False).ids, 1]) for d, x, _ in docs_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0))
    wanted, start = [], 0
    for d, ids in rows:
        wanted.append((d, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = token_files.token_files(docs, path).orderBy("start").collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == Counter(wanted)
    assert [r["doc_id"] for r in got] == [d for d, _ in rows]
    ends = np.cumsum([0, *[r["n_tokens"] for r in got]])
    assert [r["start"] for r in got] == ends[:-1].tolist()


# ------------------------------------------------------------------ piece sampling

@pytest.mark.parametrize("which", ["odd", "real", "none"])
def test_sampled_pieces_decode_to_the_text(request, which):
    docs = request.getfixturevalue(which)
    path = tokenizer_file("piece_bpe_32k.model")
    out = piece_sampling.sampled_pieces(docs, path, with_text=True)
    rows = out.collect()
    assert Counter((r["doc_id"], r["decoded"]) for r in rows) == Counter((d, t) for d, t, _ in docs_of(docs))
    assert all(r["n_pieces"] == len(r["piece_ids"]) for r in rows)
    again = docs.repartition(5).sortWithinPartitions("text")
    assert Counter((r["doc_id"], tuple(r["piece_ids"])) for r in rows) == Counter((r["doc_id"], tuple(r["piece_ids"])) for r in piece_sampling.sampled_pieces(again, path).collect())


def test_segmentations_follow_their_weights():
    path = tokenizer_file("piece_bpe_32k.model")
    tables = piece_sampling.lattices(path, 1.0)
    text, n = "hello", 4000
    drawn = Counter(tuple(x) for x in piece_sampling.encode_texts([text] * n, list(range(n)), path, 1.0))
    weight = {p: np.prod([tables.weights[i] for i in p]) for p in drawn}
    total = sum(weight.values())
    for p, k in drawn.items():
        share = weight[p] / total
        assert abs(k / n - share) < 5 * (share / n) ** 0.5 + 0.01


def spellings(text, tables):
    """Every spelling of a text by brute force, with its share of all weights; texts of characters that are pieces."""
    piece = {b.decode(): i for i, b in enumerate(tables.bytes_of) if tables.weights[i] > 0}
    found = []

    def walk(rest, ids, weight):
        if not rest:
            found.append((tuple(ids), weight))
        for k in range(1, len(rest) + 1):
            if rest[:k] in piece:
                walk(rest[k:], [*ids, piece[rest[:k]]], weight * tables.weights[piece[rest[:k]]])

    walk(" " + text, [], 1.0)
    total = sum(w for _, w in found)
    return {ids: w / total for ids, w in found}


@pytest.mark.parametrize("text", ["    if", "a   b", "  "])
def test_pieces_of_several_spaces_are_drawn(text):
    path, n = tokenizer_file("piece_bpe_32k.model"), 4000
    tables = piece_sampling.lattices(path, 1.0)
    wanted = spellings(text, tables)
    drawn = Counter(tuple(x.tolist()) for x in piece_sampling.encode_texts([text] * n, list(range(n)), path, 1.0))
    assert set(drawn) <= set(wanted) and any(tables.bytes_of[i].startswith(b"  ") for x in drawn for i in x)
    for ids, share in wanted.items():
        assert abs(drawn[ids] / n - share) < 5 * (share / n) ** 0.5 + 0.01


def test_steps_from_prefix_to_prefix_equal_those_of_a_dictionary():
    tables = piece_sampling.lattices(tokenizer_file("piece_bpe_32k.model"), 1.0)
    pieces = {b.decode().replace(" ", piece_sampling.SPACE) for b, w in zip(tables.bytes_of, tables.weights, strict=True) if w}
    text = "▁the▁naïve▁汉字▁𝄞▁strawberries▁" + piece_sampling.MARK + "".join(sorted(pieces)[::40]) + "\n"
    chars = np.array(list(map(ord, text)), dtype=np.int64)
    got = {(e, n) for ends, n, _ in tables.matches(chars) for e in ends.tolist()}
    wanted = {(i + n, n) for i in range(len(text)) for n in range(1, tables.longest + 1) if text[i : i + n] in pieces and i + n <= len(text)}
    assert got == wanted and all(len(set(ends.tolist())) == len(ends) for ends, _, _ in tables.matches(chars))


def test_long_runs_are_one_lattice():
    path, n = tokenizer_file("piece_bpe_32k.model"), 300
    tables = piece_sampling.lattices(path, 1.0)
    text = "hello" * 60
    assert [len(x) for x in piece_sampling.segments_of(text)] == [301]
    cut = 0
    for x in piece_sampling.encode_texts([text] * n, list(range(n)), path, 1.0):
        assert piece_sampling.decode(x, path) == text
        cut += 48 in np.cumsum([len(tables.bytes_of[i]) for i in x])
    assert 0 < cut < n
    long = "x" * 100_000
    assert piece_sampling.decode(piece_sampling.encode_texts([long], [1], path, 1.0)[0], path) == long


def test_scaled_sums_give_the_same_draws(monkeypatch):
    path = tokenizer_file("piece_bpe_32k.model")
    texts = ["internationalization", "https://example.org/pages", "hello"]
    plain = piece_sampling.Lattices(path, 1.0)
    plain.add([piece_sampling.SPACE + t for t in texts])
    monkeypatch.setattr(piece_sampling, "SEGMENT", 3)
    scaled = piece_sampling.Lattices(path, 1.0)
    scaled.add([piece_sampling.SPACE + t for t in texts])
    assert np.allclose(plain.within, scaled.within)


def test_many_new_segments_take_little_memory_on_the_way(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(5)
    new = sorted({piece_sampling.SPACE + "".join(map(chr, 97 + rng.integers(0, 26, 8))) for _ in range(40_000)})
    which, seeds = np.arange(len(new)), np.arange(len(new), dtype=np.uint64) << np.uint64(32)
    drawn = []
    for most in (piece_sampling.SLICE_CHARS, 1 << 40):
        monkeypatch.setattr(piece_sampling, "SLICE_CHARS", most)
        tables = piece_sampling.Lattices(tokenizer_file("piece_bpe_32k.model"), 1.0)
        tracemalloc.start()
        tables.add(new)
        held, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        drawn.append((peak - held, *(x.tolist() for x in tables.sample(which, seeds))))
    (little, *sliced), (much, *whole) = drawn
    assert sliced == whole
    assert little < 50_000_000 < much


def test_private_characters_do_not_stop_the_lattice(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    text = "the quick brown fox \ue000 and \ue001\n the ▁ lazy dog"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = piece_sampling.sampled_pieces(docs, path, with_text=True).head()
    assert r["decoded"] == text and r["n_pieces"] < len(text.encode()) + 1


# ------------------------------------------------------------------ toxicity

def test_toxicity_on_held_out_labels(spark):
    data = "/root/testdata/sf0.1"
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    fitted = labels.where("doc_id % 2 = 0")
    model = toxicity.fit(docs, fitted)
    rows = toxicity.severity(docs, model).join(labels.where("doc_id % 2 = 1").withColumnRenamed("toxic", "label"), "doc_id").collect()
    toxic = [r for r in rows if r["label"] == 1]
    clean = [r for r in rows if r["label"] == 0]
    assert sum(r["toxic"] for r in toxic) >= 0.9 * len(toxic)
    assert sum(r["toxic"] for r in clean) <= 0.02 * len(clean)


def marked(spark, rows):
    """Documents and labels of (doc_id, text, toxic)."""
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")


def test_toxicity_with_odd_rows(spark, odd, none):
    rows = [(i, "bad awful", 1) for i in range(6)] + [(10 + i, "good day", 0) for i in range(6)] + [(30, None, 0), (31, "", None), (None, "bad", 1)]
    docs, labels = marked(spark, rows)
    model = toxicity.fit(docs.union(docs), labels.union(labels))  # repeated rows count once
    assert model.cuts[0] < model.cuts[1] and model.weights
    assert model == toxicity.fit(docs, labels)
    rows = toxicity.severity(odd, model).collect()
    assert len(rows) == odd.count() and not any(r["toxic"] for r in rows)
    assert toxicity.severity(none, model).count() == 0
    assert toxicity.clean(odd, model).count() == odd.count() and toxicity.clean(odd, model).columns == odd.columns
    assert toxicity.fit(docs.limit(0), labels).weights == {}
    assert toxicity.fit(docs, labels.where("toxic = 0")).cuts[0] > 0


def test_severity_equals_the_sum_of_weights(spark):
    from math import exp

    model = toxicity.OrdinalModel({"awful": 1.5, "awfu*": 0.5, "bad": 1.0}, [1.0, 2.0])
    texts = ["awful bad bad", "Awfully kind", "", None, "bad " * 50_000, "good", "bad-bad_bad3 awful"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.severity(docs, model).collect()}
    for i, t in enumerate(texts):
        held = toxicity.features(t)
        margin = sum(w * (1 + np.log(held[f])) for f, w in model.weights.items() if held[f])
        p = [1 / (1 + exp(c - margin)) for c in model.cuts]
        assert got[i]["severity"] == pytest.approx(sum(p)) and got[i]["p_grade1"] == pytest.approx(p[0])
        assert got[i]["grade"] == sum(x >= 0.5 for x in p)


def test_labelled_sample_is_bounded(spark):
    rows = [(i, "bad awful words" if i % 2 else "good day", i % 2) for i in range(60)]
    docs, labels = marked(spark, rows)
    assert toxicity.fit(docs, labels, most=4, seen=1, least=0.1).weights  # four documents do
    assert not toxicity.fit(docs, labels, most=4, seen=5).weights


def test_special_tokens_in_any_case_are_encoded_as_the_library_does():
    import random

    encoder = token_files.Encoder(tokenizer_file("word_bpe_49k.json"), 2)
    rng = random.Random(3)
    bits = ["see", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endoftext|>", "<|startoftext|>", "<|StartOfText|>", "It's", "x.", "Größe", "<|", "|>", "endoftext", "A", " ", "\n", ".", "ÉÀ"]
    texts = ["see <|ENDOFTEXT|> here"] + ["".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text
