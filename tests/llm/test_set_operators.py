"""Operators that compare texts: copies, near copies, repeated lines and strings, neighbours, mixing."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import ann, components, exact_dedup, line_dedup, minhash, mixing, repeats, suffix_sort
from ledgerspark.llm.common import Scratch

SCHEMA = "doc_id bigint, text string, source string, _f int, suspect string"


def frame(spark, texts):
    """Rows with ids, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(k, t, f"s{k % 3}" if k and k % 5 else None, k, "x") for k, t in texts], SCHEMA)


def scratch(spark):
    return Scratch(spark, "test")


TEXTS = [(1, "Same text"), (2, "same TEXT"), (2, "same text"), (3, None), (4, ""), (None, "same text"), (5, "Äsame"), (6, "äsame"), (7, "long " * 30_000), (8, "LONG " * 30_000), (9, "alone")]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 0)], ids=["sha256", "all clash"])
def test_exact(spark, digest):
    rows = exact_dedup.exact_groups(frame(spark, TEXTS), scratch(spark), digest=digest).select("doc_id", F.col("keep.doc_id").alias("keep"), "n", F.expr(exact_dedup.KEPT).alias("kept")).collect()
    assert Counter((r.doc_id, r.keep, r.n) for r in rows) == Counter([(1, 2, 4), (2, 2, 4), (2, 2, 4), (None, 2, 4), (3, 4, 2), (4, 4, 2), (5, 5, 1), (6, 6, 1), (7, 8, 2), (8, 8, 2), (9, 9, 1)])
    assert sorted(r.doc_id for r in rows if r.kept) == [2, 4, 5, 6, 8, 9]


def test_exact_drops_and_batches(spark):
    docs = frame(spark, TEXTS)
    kept = exact_dedup.drop_copies(docs, scratch(spark))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 4, 5, 6, 8, 9]
    many = exact_dedup.exact_groups(docs.repartition(6), scratch(spark), bytes_per_batch="1")
    assert Counter((r.doc_id, r.keep.doc_id, r.n) for r in many.collect())[(1, 2, 4)] == 1
    assert exact_dedup.exact_groups(docs.where("false"), scratch(spark)).count() == 0
    assert exact_dedup.drop_copies(docs.where("false"), scratch(spark)).count() == 0


def test_join_groups_neither_loses_nor_repeats_rows(spark, monkeypatch):
    """Many keys tie for the last hot places; the hot ones are found anew wherever they are used."""
    from ledgerspark.llm import common

    monkeypatch.setattr(common, "HOT_KEYS", 7)
    work = scratch(spark)
    rows = work.write(spark.range(4000).select("id", (F.col("id") % 1000).alias("key")).repartition(13), "rows")
    groups = work.write(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).repartition(11), "groups")
    out = common.join_groups(rows, groups, "key")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "n#" in plan and all("key#" in line.split("[", 1)[1] for line in plan.splitlines() if "Sort [" in line)
    assert sorted(r.id for r in out.collect()) == list(range(4000)) and {r.n for r in out.collect()} == {4}


def test_exact_keeps_state_between_calls(spark, tmp_path):
    state = f"file://{tmp_path}/state"
    for texts, want in (([(1, "a"), (2, "b")], {1: (1, 1), 2: (2, 1)}), ([(3, "A"), (4, "c")], {3: (3, 2), 4: (4, 1)}), ([(0, "b"), (5, "x")], {0: (2, 2), 5: (5, 1)})):
        rows = exact_dedup.exact_groups(frame(spark, texts), scratch(spark), state=state).collect()
        assert {r.doc_id: (r.keep.doc_id, r.n) for r in rows} == want


def jaccard_components(texts, k, percent):
    lower = {c: c + 32 for c in range(65, 91)}
    sets = []
    for _, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        ids[find(i)].append(d)
    return [(d, len(s), min((x for x in ids[find(i)] if x is not None), default=None)) for i, ((d, _), s) in enumerate(zip(texts, sets))]


def near_texts(rng):
    vocabulary = [f"w{k}" for k in range(40)]
    texts = [(1, None), (2, ""), (3, "one two"), (4, "ONE two"), (5, "one"), (None, "one two"), (6, " \n "), (3, "one two")]
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([12, 60, 200]))]
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(0, len(own) // 20)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append((100 + len(texts), " ".join(own)))
    return texts


@pytest.mark.parametrize("words, cell, shingles", [(4, 1024, 1 << 21), (5, 3, 1000)])
def test_near(spark, words, cell, shingles, monkeypatch):
    monkeypatch.setattr(minhash, "CELL", cell)
    monkeypatch.setattr(minhash, "CELL_SHINGLES", shingles)
    texts = near_texts(random.Random(words))
    docs = frame(spark, texts)
    rows = minhash.near_groups(docs, scratch(spark), words=words).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(jaccard_components(texts, words, 80))
    kept = minhash.drop_near(docs, scratch(spark), words=words)
    assert kept.columns == docs.columns and kept.count() == sum(r.keeper for r in rows)


def test_long_words_that_sums_of_powers_confuse(spark):
    """A Thue-Morse word and its complement share nothing, whatever the base of a polynomial modulo 2**64."""
    word = "".join("ab"[k.bit_count() % 2] for k in range(2048))
    texts = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    rows = minhash.near_groups(frame(spark, texts), scratch(spark)).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 2, 3: 1}


def test_bucket_of_several_components(spark, monkeypatch):
    """A passage puts many texts in the same buckets, larger than a cell, where they belong to several groups."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    passage, texts = [rng.choice(words) for _ in range(150)], []
    for family in range(8):
        base = passage + [rng.choice(words) for _ in range(60)]
        for _ in range(40):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(150, len(own))] = rng.choice(words)
            texts.append((len(texts), " ".join(own)))
    rng.shuffle(texts)
    monkeypatch.setattr(minhash, "CELL", 16)
    rows = minhash.near_groups(frame(spark, texts), scratch(spark), words=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in rows) == Counter(jaccard_components(texts, 4, 80))


def test_near_empty(spark):
    docs = frame(spark, TEXTS).where("false")
    assert minhash.near_groups(docs, scratch(spark)).count() == 0 and minhash.drop_near(docs, scratch(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    for n, m in ((60, 40), (60, 90), (200, 199)):
        edges = [(k, k + 1) for k in range(n - 1)] if m == 199 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        root = list(range(n))
        for _ in range(n):
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        out = components.components(spark.createDataFrame(edges, "u bigint, v bigint"), scratch(spark), "c").collect()
        assert {r.node: r.root for r in out} == {k: r for k, r in enumerate(root) if k != r}
    assert components.components(spark.createDataFrame([], "u bigint, v bigint"), scratch(spark), "c").count() == 0


def cut_lines(texts, run, long):
    seen, out = set(), []
    for _, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines = (t or "").split("\n")
        gone = set()
        for n in {run, 1}:
            for i in range(len(lines) - n + 1):
                w = tuple(lines[i : i + n])
                if "".join(w).strip(" \t\r") and (n == run or len(w[0]) >= long):
                    if (n, w) in seen:
                        gone |= set(range(i, i + n))
                    seen.add((n, w))
        out.append((_, len(lines), len(gone), "\n".join(x for k, x in enumerate(lines) if k not in gone)))
    return Counter(out)


@pytest.mark.parametrize("run, long", [(1, 80), (2, 80), (3, 4)])
def test_lines(spark, run, long):
    rng = random.Random(run)
    texts = [(None, "a\nb\nc"), (1, None), (2, ""), (3, "\n\n\n"), (4, "x\n" * 3000), (5, "one"), (6, "one"), (7, "p" * 80), (8, "x\n" + "p" * 80 + "\ny"), (9, "z\n" + "p" * 80), (9, " " * 90 + "\n" + " " * 90)]
    texts += [(10 + k, "\n".join(rng.choice(["a", "b", "c", "d", "e", "é", " ", "abcd", "dcba"]) for _ in range(rng.randint(1, 12)))) for k in range(40)]
    docs = frame(spark, texts)
    cut = line_dedup.cut_lines(docs, scratch(spark), run=run, long=long).select("row.doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(map(tuple, cut)) == cut_lines(texts, run, long)
    assert line_dedup.cut_lines(docs.where("false"), scratch(spark), run=run).count() == 0


def test_suffixes():
    rng = np.random.default_rng(0)
    block = suffix_sort.BLOCK
    try:
        for it in range(400):
            text = rng.integers(0, rng.integers(1, 5), rng.integers(1, 50)).astype(np.uint16)
            if it % 3 == 0:
                text = np.tile(text[: max(1, len(text) // 5)], 6)
            cap, want = int(rng.integers(1, 12)), sorted(range(len(text)), key=lambda i: text[i:].tolist())[::-1]
            suffix_sort.BLOCK = int(rng.choice([1, 3, 1000]))
            at, lcp = [], []
            suffix_sort.induced_order(text, cap, lambda a, n: (at.extend(a.tolist()), lcp.extend(n.tolist())), buffer=int(rng.choice([1, 10**6])), in_memory=int(rng.choice([0, 10**6])))
            assert at == want
            for a, b, n in zip(want, want[1:], lcp[1:]):
                k = 0
                while k < cap and max(a, b) + k < len(text) and text[a + k] == text[b + k]:
                    k += 1
                assert n == k
    finally:
        suffix_sort.BLOCK = block


def test_long_repeats_are_not_compared_by_symbols(monkeypatch):
    """Common prefixes of the sort's neighbours come from its names; symbols are compared only where names end, also with ties beyond the width."""
    rng = np.random.default_rng(1)
    passages = [rng.integers(1, 257, n).astype(np.uint16) for n in (150, 399, 400, 401, 900, 2000)] + [np.full(700, 7, np.uint16), np.tile(np.uint16([5, 9]), 350)]
    text = np.concatenate([x for k in rng.integers(0, len(passages), 120) for x in (passages[k], rng.integers(1, 257, k).astype(np.uint16), [0])]).astype(np.uint16)
    compared, common = [], suffix_sort.common_prefix

    def spy(*given):
        out = common(*given)
        compared.extend(out.tolist())
        return out

    monkeypatch.setattr(suffix_sort, "common_prefix", spy)
    data = text.astype(">u2").tobytes()
    starts = [data[2 * i : 2 * i + 800] for i in range(len(text))]
    seen = Counter(x for x in starts if len(x) == 800)
    assert suffix_sort.repeated_windows(text, 400).tolist() == [seen[x] > 1 for x in starts]
    assert compared and sum(compared) < 20 * len(compared)


def cut_strings(texts, width):
    data = [(t or "").encode() for _, t in texts]
    seen = Counter(t[i : i + width] for t in data for i in range(len(t) - width + 1))
    out = []
    for (d, _), t in zip(texts, data):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("width, gram, shard", [(20, 8, 1 << 22), (16, 16, 300)])
def test_repeats(spark, width, gram, shard, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD", shard)
    rng = random.Random(width)
    parts = ["".join(rng.choice("abcé \0") for _ in range(rng.randint(5, 60))) for _ in range(12)]
    texts = [(1, None), (2, ""), (3, "short"), (None, "a" * 100), (4, "ab" * 60), (4, "ab" * 60), (5, "x" * 20), (6, "y" + "z" * 19 + "y" + "z" * 19)]
    texts += [(10 + k, "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))) for k in range(40)]
    docs = frame(spark, texts)
    cut = repeats.cut_repeats(docs, scratch(spark), width=width, gram=gram)
    rows = cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, rows)) == cut_strings(texts, width)
    assert repeats.cut_repeats(docs.where("false"), scratch(spark), width=width, gram=gram).count() == 0


def test_hot_anchor_is_split(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 2000, raising=False)
    seen, sort = [], repeats._sorted_shards

    def spy(contents, shards, width):
        seen.extend(r["size"] for r in contents.groupBy("anchor").agg(F.sum(F.octet_length("content")).alias("size")).collect())
        return sort(contents, shards, width)

    monkeypatch.setattr(repeats, "_sorted_shards", spy)
    rng = random.Random(3)
    part = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    passage, near = part(24), [part(9) for _ in range(3)]
    texts = [(k, part(rng.randint(0, 30)) + rng.choice(near) + passage + rng.choice(near) + part(rng.randint(0, 30))) for k in range(300)]
    texts += [(300, passage[:19]), (301, texts[0][1]), (None, texts[1][1]), (302, part(90))]
    cut = repeats.cut_repeats(frame(spark, texts), scratch(spark), width=20, gram=10)
    rows = cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
    assert Counter(map(tuple, rows)) == cut_strings(texts, 20)
    assert max(seen, default=0) <= 2000


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(300)] + [(300, None), (400, [0.0] * 8), (500, [float("nan")] * 8), (600, [None] * 8), (700, [1.0]), (None, [1.0] * 8), (100, rng.normal(size=8).tolist()), (800, [float("inf")] + [0.0] * 7)]
    rows.append((3, rows[2][1]))
    table = spark.createDataFrame([(k, v, 0, "q") for k, v in rows], "vec_id bigint, embedding array<double>, score int, q string")
    out = ann.nearest(table, scratch(spark), F.col("vec_id") % 100 == 0).collect()
    usable = [(k, np.array(v)) for k, v in rows if v and len(v) == 8 and None not in v and np.isfinite(v).all() and any(v)]
    want = []
    for i, (q, x) in enumerate(usable):
        if q is not None and q % 100 == 0:
            far = sorted((float(np.sqrt(((x - y) ** 2).sum())), 1 << 62 if k is None else k, k) for j, (k, y) in enumerate(usable) if j != i)[:10]
            want += [(q, n + 1, k) for n, (_, _, k) in enumerate(far)]
    got = Counter((r.query_id, r["rank"], r.vec_id) for r in out)
    assert sum((got & Counter(want)).values()) >= 0.9 * len(want) and len(out) == len(want)
    assert ann.nearest(table.where("false"), scratch(spark), F.col("vec_id") % 100 == 0).count() == 0
    one = table.where("vec_id = 200")
    assert ann.nearest(one, scratch(spark), F.col("vec_id") % 100 == 0).count() == 0


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_neighbours_recall(spark, scale):
    table = spark.read.parquet(f"/root/testdata/{scale}/embeddings.parquet")
    found = defaultdict(set)
    for r in ann.nearest(table, scratch(spark), F.col("vec_id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
    data = table.toPandas()
    x, ids = np.stack(data.embedding.map(lambda v: np.array(v, float))), data.vec_id.to_numpy()
    hit = total = 0
    for q in np.flatnonzero(ids % 100 == 0):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        true = set(ids[np.argsort(far)[:10]].tolist())
        hit, total = hit + len(true & found[int(ids[q])]), total + len(true)
    assert hit >= 0.9 * total


def test_neighbours_in_clusters_need_few_candidates(spark, monkeypatch):
    """Data with structure, several shards: recall by comparing few rows, whatever the partitions."""
    monkeypatch.setattr(ann, "SHARD", 3000)
    rng = np.random.default_rng(9)
    x = np.repeat(rng.normal(size=(200, 32)) * 5, 40, axis=0) + rng.normal(size=(8000, 32))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    found, compared = defaultdict(set), []
    for r in ann.nearest(table, scratch(spark), F.col("vec_id") % 100 == 0).collect():
        found[r.query_id].add(r.vec_id)
        compared.append(r.compared)
    hit = 0
    for q in range(0, 8000, 100):
        far = ((x - x[q]) ** 2).sum(1)
        far[q] = np.inf
        hit += len(set(np.argsort(far)[:10].tolist()) & found[q])
    assert hit >= 0.9 * 800 and np.mean(compared) < 0.25 * 8000 / 3


def test_neighbours_of_several_lengths(spark):
    rows = [(k, [float(k), 1.0] if k % 2 else [float(k), 2.0, 3.0]) for k in range(1, 60)] + [(0, [0.5, 1.0]), (100, [1.0, 2.0, 3.0])]
    out = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), scratch(spark), F.col("vec_id") % 100 == 0).collect()
    near = lambda q: [r.vec_id for r in sorted(out, key=lambda r: r["rank"]) if r.query_id == q]
    assert near(0) == list(range(1, 20, 2)) and near(100) == list(range(2, 21, 2))


def test_targets():
    t = mixing.targets({"a": 100, "b": 100, "c": 100})
    assert t == pytest.approx({"a": 200, "b": 500 / 3, "c": 250 / 3})
    t = mixing.targets({"a": 10, "b": 0, None: 1000})
    assert t["a"] == 20 and t["b"] == 0 and t[None] == 1515 - 20


def test_route_takes_all_it_can_with_least_repetition():
    rng = random.Random(6)
    for _ in range(60):
        names = ["a", "b", "c"]
        patterns = {tuple(sorted(rng.sample(names, rng.randint(1, 3)))): rng.randint(1, 4) for _ in range(rng.randint(1, 4))}
        quotas = {s: rng.randint(0, 5) for s in names}
        got = mixing.route(patterns, quotas)
        each = {p: sum(f.values()) for p, f in got.items()}
        for s in names:
            assert sum(f.get(s, 0) for f in got.values()) <= quotas[s]
        best = None

        def tries(left, todo, total, again):
            nonlocal best
            if not todo:
                best = max(best or (-1, 0), (total, -again))
                return
            p, n = todo[0]

            def split(k, rest, given):
                if k == len(p):
                    tries(rest, todo[1:], total + given, again + max(0, given - n))
                    return
                for amount in range(min(rest[p[k]], 2 * n - given) + 1):
                    split(k + 1, {**rest, p[k]: rest[p[k]] - amount}, given + amount)

            split(0, left, 0)

        tries(quotas, list(patterns.items()), 0, 0)
        assert (sum(each.values()), -sum(max(0, each[p] - n) for p, n in patterns.items())) == best


def test_mix(spark):
    rng = random.Random(8)
    texts = [(k, " ".join("w" for _ in range(rng.randint(0, 30)))) for k in range(400)] + [(7, "w w w"), (None, None), (7, "w w w")]
    docs = frame(spark, texts)
    rows = mixing.mix(docs, scratch(spark), F.array("source")).collect()
    assert len(rows) == len(texts)
    taken, target = Counter(), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and (not r.size or r.taken % r.size == 0)
        taken[r.sources[0]] += r.taken
        target[r.sources[0]] = r.target
    assert all(abs(taken[s] - t) <= 2 for s, t in target.items())
    again = mixing.mix(docs.repartition(5), scratch(spark), F.array("source")).collect()
    by_id = lambda out: sorted((r.doc_id, r.taken) for r in out if r.doc_id not in (7, None))
    assert by_id(rows) == by_id(again)
    copies = mixing.repeat_documents(docs, scratch(spark))
    assert copies.columns == docs.columns and copies.count() == sum(r.times for r in rows)
    assert mixing.mix(docs.where("false"), scratch(spark), F.array("source")).count() == 0


def test_mix_overlapping_sources(spark):
    rows = [(k, "w " * 10, ["a", "b"] if k % 2 else ["a"]) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, member array<string>")
    out = mixing.mix(docs, scratch(spark), F.col("member")).collect()
    assert len(out) == 100 and abs(sum(r.taken for r in out) - 1500) <= 10


def test_every_pattern_goes_through_the_flow(spark, monkeypatch):
    runs = []
    run = mixing._Flow.run
    monkeypatch.setattr(mixing._Flow, "run", lambda self, a, b: (runs.append(len(self.to)), run(self, a, b))[1])
    mixing.op7_mixing(spark, "/root/testdata/sf0.001")
    sources = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source").distinct().count()
    assert len(runs) == sources  # no two of them overlap there


def test_mix_goes_on_past_long_documents(spark):
    """Documents of 3,000 words at any place of the order don't keep the others from filling the gap."""
    sizes = [3000 if k % 10 == 3 else 40 + k for k in range(60)]
    docs = spark.createDataFrame([(k, "w " * n, "a" if k % 2 else "b") for k, n in enumerate(sizes)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, scratch(spark), F.array("source")).collect()
    for source in ("a", "b"):
        own = [r for r in rows if r.sources == [source]]
        gap = own[0].target - sum(r.taken for r in own)
        least = min(r.times for r in own)
        assert abs(gap) <= 0.05 * own[0].target
        assert all(abs(gap - r.size) >= abs(gap) - 1 for r in own if r.times == least)  # no document lowers it


def test_too_many_patterns_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_PATTERNS", 2)
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, [(k, "a b") for k in range(9)]), scratch(spark), F.array("source"))


def test_repeats_in_production(spark, tmp_path, monkeypatch):
    """The production width on many small files and partitions: passages of 300 to 900 bytes, one of them in a third
    of the documents, copies, and anchors hot enough to be dealt out by digests as well as sorted."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [some(rng.randint(45, 140)) for _ in range(60)]
    texts = [(0, None), (1, "")]
    for k in range(2, 900):
        middle = passages[0] if k % 3 == 0 else rng.choice(passages) if k % 3 == 1 else some(5)
        texts.append((k, f"{some(rng.randint(0, 120))} {middle} {some(rng.randint(0, 120))}"))
    texts += [(1000 + k, texts[10 * k + 5][1]) for k in range(20)]
    path = str(tmp_path / "docs")
    frame(spark, texts).repartition(64).write.parquet(path)
    want = cut_strings(texts, repeats.WIDTH)
    assert sum(row[2] > 0 for row in want) > 300
    for hot in (repeats.HOT, 20_000):
        monkeypatch.setattr(repeats, "HOT", hot)
        cut = repeats.cut_repeats(spark.read.parquet(path), scratch(spark))
        rows = cut.select("row.doc_id", "n_bytes", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()
        assert Counter(map(tuple, rows)) == want
