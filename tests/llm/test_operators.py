"""Operators against plain versions on small tables with nulls, ties, empty and repeated rows."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from graphloom.llm import decontam, jaccard, lm, mixing, rules, sharding, substring, suffix, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long"


def texts(seed=1, n=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        words = [r.choice(vocabulary) for _ in range(r.choice([0, 1, 4, 5, 30, 60, 120]))]
        if i % 5 == 0 and out:
            words = (out[r.randrange(len(out))] or "").split()
            if words and i % 10 == 0:
                words[r.randrange(len(words))] = "CHANGED"
        out.append(" ".join(words))
    return [*out, None, None, "", " \n\t ", "Ä ö\x0b x\x00y", out[7], out[7]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i % 13 else None, t, "en" if i % 3 else None, f"s{i % 4}" if i % 7 else None, 0, 1) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return (t or "").encode().split()


def lowered(t):
    return (t or "").encode().lower().split()


def shingles(t, k=5):
    w = lowered(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def covered(items, length):
    count = Counter(x[i : i + length] for x in items for i in range(len(x) - length + 1))
    out = []
    for x in items:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(gone)
    return out


@pytest.mark.parametrize("length", [8, 20, 35])
def test_substrings(docs, length):
    got = Counter((r[0], r[1], r[2], r[4]) for r in rows_of(substring.dedup_substrings(docs, length)))
    rows = rows_of(docs.select("doc_id", "text"))
    items = [tuple(words(t)) for _, t in rows]
    want = Counter()
    for (i, _), w, g in zip(rows, items, covered(items, length)):
        want[i, len(w), int(g.sum()), hashlib.sha256(b" ".join(x for x, y in zip(w, g) if not y)).hexdigest()] += 1
    assert got == want


def test_suffixes(docs):
    got = Counter((r[0], r[1], r[2], r[3], r[5]) for r in rows_of(suffix.dedup_suffixes(docs, 60)))
    rows = rows_of(docs.select("doc_id", "text"))
    items = [(t or "").encode() for _, t in rows]
    want = Counter()
    for (i, _), x, g in zip(rows, items, covered(items, 60)):
        spans = int((np.diff(g.astype(int), prepend=0) == 1).sum())
        want[i, len(x), int(g.sum()), spans, hashlib.sha256(bytes(b for b, y in zip(x, g) if not y)).hexdigest()] += 1
    assert got == want


def test_suffix_groups_are_all_maximal_repeats():
    r = random.Random(3)
    for _ in range(50):
        strings = list({bytes(r.choice(b"ab\x00") for _ in range(r.randint(1, 30))) for _ in range(4)})
        group, string, offset, length = suffix.repeat_groups(strings, np.ones(len(strings), int), 3)
        got = set()
        for k in set(group.tolist()):
            at = [(int(string[i]), int(offset[i])) for i in np.flatnonzero(group == k)]
            n = int(length[group == k][0])
            assert len({strings[s][o : o + n] for s, o in at}) == 1
            got.add((strings[at[0][0]][at[0][1] :][:n], len(at)))
        every = Counter(x[i:j] for x in strings for i in range(len(x)) for j in range(i + 3, len(x) + 1))
        for sub, times in got:
            assert every[sub] == times > 1
        # Completeness: each substring whose occurrences differ on both sides, an edge being unlike all else.
        left, right = {}, {}
        for k, x in enumerate(strings):
            for i in range(len(x)):
                for j in range(i + 3, len(x) + 1):
                    left.setdefault(x[i:j], set()).add(x[i - 1] if i else ("edge", k))
                    right.setdefault(x[i:j], set()).add(x[j] if j < len(x) else ("edge", k))
        assert got == {(sub, n) for sub, n in every.items() if n > 1 and len(left[sub]) > 1 and len(right[sub]) > 1}


def test_jaccard(docs):
    got = Counter(rows_of(jaccard.jaccard_classes(docs)))
    rows = rows_of(docs.select("doc_id", "text"))
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if shared and 100 * shared >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = Counter((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets)))
    assert got == want


def test_long_runs_lose_no_link(spark):
    r = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    made = []
    for i in range(90):
        w = list(base)
        for _ in range(r.choice([0, 2, 3, 4, 5])):
            w[r.randrange(len(w))] = f"x{i}_{r.random()}"
        made.append((i, " ".join(w)))
    got = dict((a, c) for a, _, c in rows_of(jaccard.jaccard_classes(spark.createDataFrame(made, "doc_id long, text string"))))
    sets = [shingles(t) for _, t in made]
    root = list(range(90))
    for _ in range(90):
        for i in range(90):
            for j in range(90):
                if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    root[i] = root[j] = min(root[i], root[j])
    assert [got[i] for i in range(90)] == root


def test_representatives_keep_columns(docs, none):
    kept = jaccard.representatives(docs)
    assert kept.columns == docs.columns
    ids = [r.component_id for r in jaccard.jaccard_classes(docs).where("n_shingles > 0").distinct().collect()]
    assert kept.where("text is not null and trim(text) <> ''").count() >= len(set(ids)) - 1
    assert kept.where("text is null").count() == 2
    assert jaccard.representatives(none).count() == 0


def test_containment(spark, docs):
    items = [(1, texts()[12]), (2, None), (3, ""), (None, "one two"), (5, (texts()[11] or "")[:150])]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = Counter(rows_of(decontam.contained_items(docs, frame)))
    want = Counter()
    for d, t in rows_of(docs.select("doc_id", "text")):
        for i, x in items:
            s = shingles(x)
            if s and 100 * len(s & shingles(t)) >= 75 * len(s):
                want[d, i, len(s & shingles(t)), len(s)] += 1
    assert got == want
    hit = lambda t: any(shingles(x) and 100 * len(shingles(x) & shingles(t)) >= 75 * len(shingles(x)) for _, x in items)
    assert decontam.decontaminate(docs, frame).count() == sum(not hit(t) for _, t in rows_of(docs.select("doc_id", "text")))


def test_short_items_are_never_missed():
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(8))
    item = " ".join(word() for _ in range(5))
    texts = [" ".join([*(word() for _ in range(r.randrange(3, 9))), item, *(word() for _ in range(9))]).encode() for _ in range(20_000)]
    s = jaccard.shingle_sets([item.encode()], 5)[0]
    bits = np.zeros(1 << decontam.BITS, bool)
    bits[decontam.Bitmap.places(s)] = True
    found = decontam.search(decontam.Bitmap(np.packbits(bits, bitorder="little")), [8], texts, 5)
    keys = decontam.item_keys(s, 5)
    assert sum(bool(np.isin(keys, x).any()) for _, _, x in found) == len(texts)


def test_shards(docs, none):
    out = sharding.shard(docs, 7).collect()
    sizes = Counter(r.shard for r in out)
    assert len(out) == docs.count() and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert sharding.shard(none, 7).count() == 0


def test_language_model(docs, none):
    out = lm.score_documents(docs).collect()
    rows = rows_of(docs.select("doc_id", "text"))
    train = Counter()
    for d, t in rows:
        if lm.fold(d) != 1:
            train.update([*lowered(t), None])
    n, v = sum(train.values()), len(train)
    want = Counter((d, lm.fold(d) == 1, len(lowered(t)) + 1, sum(train[w] > 0 for w in [*lowered(t), None]), n, round(sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*lowered(t), None]), 6)) for d, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 for r in out)
    assert lm.score_documents(none).count() == 0


def test_language_model_grid_clips_nothing():
    p = np.exp2(-np.linspace(0, 63.9, 500))
    steps = lm._step(p)
    assert steps.min() == 1 and steps.max() < lm._STEPS and lm._step(np.zeros(1)).tolist() == [0]
    assert np.abs(np.log2(p) + (steps - 1) / lm._GRID).max() <= 0.5 / lm._GRID + 1e-9
    assert np.diff(lm._bucket(np.array([3 << k for k in range(62)], np.uint64))).min() == 1


def test_mixing(docs, none):
    out = mixing.weigh(docs).collect()
    assert len(out) == docs.count() and all(0 <= r.probability <= 1 for r in out)
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_mixing_keeps_its_share_beside_a_rare_cell(spark):
    schema = "doc_id long, text string, lang string, source string"
    many = [(i, "a b c d e " * (10 + i % 7), ["en", "de"][i % 5 == 0], f"s{i % 3}") for i in range(600)]
    cells = {}
    for rare in ([], [(1000, "one two", "xx", "rare")]):
        out = mixing.weigh(spark.createDataFrame(many + rare, schema)).collect()
        tokens = sum(x.n_tokens for x in out)
        assert sum(x.probability * x.n_tokens for x in out) == pytest.approx(tokens / 3, rel=1e-3)
        assert all(x.probability == 1 for x in out if x.doc_id == 1000)
        cells[len(rare)] = {(x.source, x.lang, x.topic): x.probability for x in out if x.doc_id != 1000}
    assert all(cells[1][c] == pytest.approx(p, rel=0.02) for c, p in cells[0].items())
    for axis, part in (("source", {"s0": 0.5, "s1": 0.3, "s2": 0.2}), ("lang", {"en": 1.0})):
        out = mixing.weigh(spark.createDataFrame(many, schema), targets={axis: part}).collect()
        got = Counter()
        for x in out:
            got[x[axis]] += x.probability * x.n_tokens
        assert all(got[k] / sum(got.values()) == pytest.approx(part.get(k, 0), abs=1e-3) for k in got)


def test_quality_statistics(docs, none):
    out = rules.quality(docs)
    want = Counter()
    for d, t in rows_of(docs.select("doc_id", "text")):
        w = words(t)
        g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c, cov = Counter(g), set()
        for i, x in enumerate(g):
            if c[x] > 1:
                cov.update(range(i, i + 5))
        want[d, len(w), sum(len(x.decode()) for x in w), len(cov), len(w) < 10 or 100 * len(cov) > 20 * len(w)] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) for r in out.collect()) == want
    assert rules.quality(none).count() == 0


def test_quality_rejects_junk_and_keeps_clean_documents(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.choice([3, 4, 5, 6, 7])))
    rows = [(i, " ".join(word() for _ in range(r.choice([40, 120, 400, 1500])))) for i in range(200)]
    line = " ".join(word() for _ in range(10))
    rows += [(200 + i, f"{t} # {line} {t[:30]} {line}") for i, (_, t) in enumerate(rows[:10])]
    tables = [(300 + i, " ".join(f"{word()} |" for _ in range(60))) for i in range(20)]
    junk = [(400 + i, " ".join(word() + "***" for _ in range(60))) for i in range(20)]
    out = {x.doc_id: x for x in rules.quality(spark.createDataFrame([(i, t, "en", "s") for i, t in rows + tables + junk], "doc_id long, text string, lang string, source string")).collect()}
    assert all(out[i].kept or out[i].base_failed for i, _ in rows)
    assert not any(out[i].kept or out[i].base_failed for i, _ in tables + junk)


def test_quality_of_labelled_documents(spark):
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    out = rules.quality(read("documents")).where("not base_failed").join(read("labels").groupBy("doc_id").agg({"quality": "max"}).toDF("doc_id", "quality"), "doc_id", "left").toPandas()
    junk = out[100 * out.n_symbols > 20 * out.n_words]
    assert len(junk) > 600 and junk.kept.mean() < 0.02
    clean = out[out.quality == 1]
    assert len(clean) > 3000 and clean.kept.all()


def test_toxicity(spark, none):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["calm", "tree", "road", "sun", *(["vile", "nasty"] if i % 4 == 0 else [])]) for _ in range(40))) for i in range(200)]
    frame = spark.createDataFrame([*rows, (None, None), (999, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    out = {x.doc_id: x for x in toxicity.severities(frame, labels).collect()}
    assert all(out[i].toxic == (i % 4 == 0) for i in range(200)) and not out[None].toxic and not out[999].toxic
    assert toxicity.severities(none, labels).count() == 0
    assert not any(x.toxic for x in toxicity.severities(frame, labels.where("toxic = 0")).collect())


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "u:1", "x" * 200), (2, "u:2", "x" * 200), (3, None, None), (4, "u\r\n4", "é" * 60), (5, "u:5", "short"), (6, "u:6", "short")]
    path = f"file://{tmp_path}/a"
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), path)
    got = {int(r.record_id.removeprefix('urn:page:')): r for r in warc.read(spark, path).collect()}
    assert {i: bytes(got[i].payload).decode() for i in (1, 3, 4, 5, 6)} == {1: "x" * 200, 3: "", 4: "é" * 60, 5: "short", 6: "short"}
    assert (got[2].type, got[2].refers_to, got[2].payload_bytes, bytes(got[2].payload)) == ("revisit", "urn:page:1", 200, b"")
    assert warc.read(spark, path, payload=False, kind="revisit").count() == 1
    assert warc.read(spark, path).where("type = 'response' and payload_bytes > 100").count() == 2


def test_empty_tables(none):
    for f in (substring.dedup_substrings, suffix.dedup_suffixes, jaccard.jaccard_classes):
        assert f(none).count() == 0
