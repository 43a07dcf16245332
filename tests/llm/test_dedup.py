import hashlib
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from emberlog.llm import exact_dedup, graph, jaccard_join, line_dedup
from emberlog.llm.jaccard_join import Bands, signatures, sketch, sketches_differ

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOW)


@pytest.mark.parametrize("block", [8, 4096])
def test_exact_groups(docs, rows, block):
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    want = Counter()
    for r in rows:
        own = groups[low(r[1])]
        keep = max((x for x in own if x is not None), default=None)
        want[(r[0], keep, len(own), r[0] == keep if r[0] is not None and keep is not None else keep is None, hashlib.sha256(low(r[1]).encode()).hexdigest())] += 1
    got = exact_dedup.exact_groups(docs, block_bytes=block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_keep_exact(docs, rows, empty):
    kept = exact_dedup.keep_exact(docs)
    assert kept.columns == docs.columns
    assert Counter(low(r.text) for r in kept.collect()) == Counter({low(r[1]): 1 for r in rows})
    assert exact_dedup.keep_exact(empty).count() == 0 and exact_dedup.exact_groups(empty).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", low(text))
    return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def test_jaccard_classes(docs, rows, empty):
    ids = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    root = {k: k for k in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(ids), 2):
        both = len(ids[a] & ids[b])
        if both and 100 * both >= 85 * len(ids[a] | ids[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    got = jaccard_join.jaccard_classes(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id) == (len(ids[r.doc_id]), find(r.doc_id))
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_keep_one(docs, rows, empty):
    """One row of each component stays, rows without words all stay, and other texts under a dropped id stay."""
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    wordless = sum(1 for r in rows if not shingles(r[1]))
    named = {r.component_id for r in jaccard_join.jaccard_classes(docs).collect() if r.n_shingles}
    got = kept.collect()
    assert sorted(r.doc_id for r in got if shingles(r.text)) == sorted(named) and sum(1 for r in got if not shingles(r.text)) == wordless
    assert jaccard_join.keep_one(empty).count() == 0


def test_keep_one_judges_by_id_and_text(spark):
    a, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(1, a), (5, a + " tail"), (5, other), (None, a), (None, other + " x"), (7, None), (7, ""), (9, "one two"), (9, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, jaccard_join.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, a), (5, other), (7, None), (7, ""), (9, "one two")], key=str)
    classes = jaccard_join.jaccard_classes(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in classes) == [("1", 1), ("5", 1), ("5", 5), ("7", 7), ("7", 7), ("9", 9), ("9", 9), ("None", 1), ("None", 5)]


def made_classes(spark, texts, **parameters):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_classes(docs, **parameters).collect()}
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for a, b in combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
            low_root, high_root = sorted((root[a], root[b]))
            root = [low_root if r == high_root else r for r in root]
    return got, dict(enumerate(root))


@pytest.mark.parametrize("hot", [False, True])
def test_crowded_signatures_against_brute_force(spark, monkeypatch, hot):
    """Chains, stars and a quoted passage; also where frequent signatures are left out and dealt over tasks."""
    import random

    if hot:
        monkeypatch.setattr(jaccard_join, "SAMPLE", 1)
        monkeypatch.setattr("emberlog.llm.cluster.HOT_ROWS", 8)
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 6)))
    passage, texts = " ".join(word() for _ in range(60)), []
    texts += [" ".join(word() for _ in range(70)) + " " + passage for _ in range(50)]  # these quote one passage
    base = [word() for _ in range(150)]
    for _ in range(60):  # a star: copies link with the base and not always with one another
        copy = list(base)
        for _ in range(rng.randint(1, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    texts.append(" ".join(base))
    for _ in range(40):  # a chain
        base = base[2:] + [word(), word()]
        texts.append(" ".join(base))
    got, want = made_classes(spark, texts)
    assert got == want and 50 < len(set(want.values())) < len(texts)


def test_keys_of_the_same_members_come_once(spark, monkeypatch):
    """Copies with one edit share most signatures; each set of members comes once, and no pair is lost."""
    every, few = [], []
    without, classes = jaccard_join._without_frequent, jaccard_join.classes

    def kept(*given):
        out = without(*given)
        every.extend(out.collect())
        return out

    def judged(members, *given):
        few.extend(members.collect())
        return classes(members, *given)

    monkeypatch.setattr(jaccard_join, "_without_frequent", kept)
    monkeypatch.setattr(jaccard_join, "classes", judged)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join([*base[: 20 * i], f"edit{i}", *base[20 * i + 1 :]]) for i in range(6)] + [" ".join(f"v{i}" for i in range(90 + j)) for j in range(4)]
    made_classes(spark, texts)

    def sets_of(rows):
        by = defaultdict(set)
        for r in rows:
            by[r.key].add(r.node)
        return [frozenset(v) for v in by.values() if len(v) > 1]

    before, after = sets_of(every), sets_of(few)
    assert set(before) == set(after) and len(after) == len(set(after)) < len(before)


def test_linked_sets_share_a_signature():
    rng, bands = np.random.default_rng(3), Bands()
    for size in [1, 2, 6, 7, 12, 13, 30, 57, 100, 101, 260, 700, 1500]:
        for _ in range(12):
            x = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
            n = len(x)
            most = int(n * (1 - 0.85) / 0.85)  # sets grow
            drop = int(rng.integers(0, int(n * 0.15 / 1.85) + 1))
            for y in (np.append(x[drop:], rng.integers(0, 2**63, drop, dtype=np.uint64)), np.append(x, rng.integers(0, 2**63, most, dtype=np.uint64)), x[: max(1, int(np.ceil(0.85 * n)))]):
                y = np.unique(y)
                both = len(np.intersect1d(x, y))
                if 100 * both >= 85 * (len(x) + len(y) - both):
                    assert np.intersect1d(signatures(x, bands)[0], signatures(y, bands)[0]).size
                assert sketches_differ(sketch(x), sketch(y)) <= len(x) + len(y) - 2 * both


def test_sketches_rule_out_overlapping_large_sets(spark):
    """Within the join, sets of hundreds and thousands of elements that overlap and don't link are told from those that link."""
    from pyspark.sql import functions as F

    from emberlog.llm import cluster

    rng = np.random.default_rng(6)
    rows, linked, apart = [], set(), set()
    for i, n in enumerate([300, 342, 360, 500, 680, 690, 1000, 1360, 1370, 2000, 2730, 2740, 5000] * 2):
        for share in (0.3, 0.5, 0.7, 0.86, 0.9, 0.95):
            x = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
            y = np.unique(np.concatenate([x[: int(share * n)], rng.integers(0, 1 << 63, n - int(share * n) + (n // 20) * (i % 2), np.uint64)]))
            both = len(np.intersect1d(x, y))
            if 100 * both >= 80 * (len(x) + len(y) - both):
                linked.add(len(rows))
            elif 100 * both < 55 * (len(x) + len(y) - both) and n > 350:
                apart.add(len(rows))
            mark = lambda v, m=None: np.frombuffer(sketch(v, m), np.int64).tolist()
            rows.append((len(rows), *[(len(v), *mark(v, 64 * len(cluster.SKETCH)), mark(v)) for v in (x, y)]))
    side = "struct<n:bigint," + ",".join(f"{w}:bigint" for w in cluster.SKETCH) + ",mark:array<bigint>>"
    df = spark.createDataFrame(rows, f"id long, l {side}, r {side}")
    for x in "lr":
        df = df.withColumn(x, F.col(x).withField("wide", jaccard_join.wide_sketch(F.col(f"{x}.mark"), F.col(f"{x}.n"))))
    fit = {r.id for r in df.filter(cluster._sketches_fit("l", "r", 0.8)).collect()}
    assert linked <= fit and not apart & fit and len(linked) > 20 and len(apart) > 40


def test_a_pair_of_many_keys_is_made_once(spark, monkeypatch):
    """A crowd whose members share forty keys, and pairs whose only common key comes after many others, in the last round's join."""
    from emberlog.llm import cluster

    crowd, keys = range(1, 31), range(100, 140)
    rows = [(k, n) for k in keys for n in crowd]
    late = {(201, 202), (203, 204)}
    for i, n in enumerate(x for pair in sorted(late) for x in pair):  # each shares forty lesser keys with a node of its own
        rows += [(1000 + 100 * i + k, m) for k in range(40) for m in (n, n + 100)] + [(5000 + n // 203, n)]
    nodes = sorted({n for _, n in rows})
    live = spark.createDataFrame([(k, (n, 50, n)) for k, n in rows], "key long, one struct<node:long,n:long,comp:long>")
    sketches = spark.createDataFrame([(n, 0, 0, 0, 0, None) for n in nodes], "node long, w0 long, w1 long, w2 long, w3 long, wide array<long>")
    met, made, pairs_of, materialize = [], [], cluster._pairs, cluster.materialize
    monkeypatch.setattr(cluster, "_pairs", lambda df, p, q: met.append(df) or pairs_of(df, p, q))
    monkeypatch.setattr(cluster, "STAR_ROUNDS", 0)
    monkeypatch.setattr(cluster, "PART_ROWS", 100)
    members, seen = live.select("key", "one.node", "one.n"), []
    none = lambda pairs: seen.extend((r.a, r.b) for r in pairs.collect()) or pairs.select("ca", "cb").limit(0)
    monkeypatch.setattr(cluster, "materialize", lambda df, label: (label == "pairs_of_part" and made.append(met[-1].count())) or materialize(df, label))
    cluster.classes(members, none, 0.85, sketches)
    own = {(n, n + 100) for pair in late for n in pair}
    assert sorted(seen) == sorted(set(combinations(crowd, 2)) | late | own)
    assert sum(made) <= len(seen) + 4 * (40 - cluster.LEAST), "rows of the join"


def dealt_out(df):
    """Of the query's plan after it ran: its exchanges by hash, and how many more uses of one there are."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return plan.count("- Exchange hashpartitioning("), plan.count("ReusedExchange")


def test_rows_of_a_key_are_dealt_out_once(spark):
    """Neither the choice of keys nor the last round's join shuffles the same rows twice; crowded keys still make all pairs."""
    from pyspark.sql import functions as F

    from emberlog.llm import cluster

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = [(k, k // 3 + i) for k in range(60) for i in range(4)] + [(1000, n) for n in range(cluster.BLOCK + 50)]
        members = cluster.materialize(spark.createDataFrame([(k, n, 50) for k, n in made], "key long, node long, n long"), "members")
        one = cluster.one_key_per_set(members)
        assert dealt_out(one) == (3, 1), "members, once for both uses, a row for each key, and the keys that were chosen"
        assert {r.key for r in one.collect()} == {*range(0, 60, 3), 1000}
        live = cluster.materialize(one.select("key", F.struct("node", "n", F.col("node").alias("comp")).alias("one")), "live")
        spread = cluster.materialize(live.groupBy("key").agg(F.count("*").alias("m")), "spread")
        few = spread.filter("m < 10")
        assert dealt_out(cluster._all_pairs(live, few, 0.85, None))[0] == 3, "rows and spread, each for both sides of the join, and the pairs"
        got = {(r.a, r.b) for r in cluster._all_pairs(live, spread, 0.85, None).collect()}
        assert got == {p for r in [*range(20), None] for p in combinations(range(cluster.BLOCK + 50) if r is None else range(r, r + 4), 2)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (5, 5), (None, 1)] + [(100, i) for i in range(101, 160)] + [(i, i + 1) for i in range(200, 230)]
    got = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {**{i: 1 for i in (1, 2, 3, 7, 8, 9)}, 20: 20, 21: 20, 5: 5, **{i: 100 for i in range(100, 160)}, **{i: 200 for i in range(200, 231)}}
    assert got == want
    assert graph.connected_components(spark.createDataFrame([], "src string, dst string")).count() == 0


def test_line_dedup(spark, empty):
    base = "the quick brown fox jumps over the lazy dog near the river bank while the cat sleeps on the warm red roof of the old house"
    near = base.replace("lazy", "laZy").replace("roof", "rooF") + "!"
    other = "completely different words are standing here and nobody has ever seen them in any other line of this small test table"
    rows = [(1, f"{base}\n\n{other}\nshort"), (2, f"{near}\nunique line number two is here"), (3, f" {other} \nshort\n{base}"), (4, None), (5, ""), (3, f" {other} \nshort\n{base}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.n_lines, tuple(r.dropped)) for r in line_dedup.dropped_lines(docs).collect()}
    assert got == {(1, 3, ()), (2, 2, (0,)), (3, 3, (0, 1, 2)), (4, 0, ()), (5, 0, ())}
    texts = {r.doc_id: r.text for r in line_dedup.without_lines(docs).collect()}
    assert texts == {1: rows[0][1], 2: "unique line number two is here", 3: "", 4: None, 5: ""}
    assert line_dedup.dropped_lines(empty).count() == 0
    assert line_dedup.dropped_lines(docs.filter("doc_id = 4")).first().n_dropped == 0


def test_near_lines_are_found(spark):
    """Against brute force: lines with one edit, whose shingle sets are similar enough, meet in one class."""
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    lines = []
    for _ in range(40):
        line = " ".join(word() for _ in range(25))
        i = rng.randrange(len(line))
        lines += [line, line[:i] + "#" + line[i + 1 :]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.n_dropped}
    want = {i + 1 for i in range(0, 80, 2) if alike(lines[i], lines[i + 1])}
    assert gone == want


def alike(x, y, k=5):
    a, b = ({t[i : i + k] for i in range(max(1, len(t) - k + 1))} for t in (x, y))
    return len(a & b) >= 0.8 * len(a | b)


def line_clusters(lines, pairs):
    root = list(range(len(lines)))
    for a, b in pairs:
        if root[a] != root[b] and alike(lines[a], lines[b]):
            low_root, high_root = sorted((root[a], root[b]))
            root = [low_root if r == high_root else r for r in root]
    return {i for i, r in enumerate(root) if r != i}


def test_recall_on_clusters_and_chains(spark):
    """Of the lines that brute force over all pairs drops, at least 0.99 are dropped, and no other line."""
    import random

    rng = random.Random(12)
    letter = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz éß語")
    lines = []
    for _ in range(60):
        base = [letter() for _ in range(rng.choice([30, 60, 120, 400]))]
        lines.append("".join(base))
        for _ in range(rng.randint(0, 12)):
            copy = list(base) if rng.random() < 0.6 else list(lines[-1])
            for _ in range(rng.randint(1, max(1, len(base) // 45))):
                copy[rng.randrange(len(copy))] = letter()
            lines.append("".join(copy))
    lines = list(dict.fromkeys(x.strip() for x in lines))
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    want = line_clusters(lines, combinations(range(len(lines)), 2))
    got = {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.n_dropped}
    assert len(want) > 150 and got <= want and len(got) >= 0.99 * len(want)


def test_line_dedup_edges(spark):
    """Null ids last, ties of one id by text hash, very long lines, columns with the operator's own names."""
    long = " ".join(f"word{i}" for i in range(30_000))
    rows = [(None, long), (4, "x" + long), (3, "ab\nab\n \nAB "), (3, "cd\nab"), (9, "abc"), (None, "abc")]
    docs = spark.createDataFrame([(*r, 1, "k", 2, [0]) for r in rows], "doc_id long, text string, h long, k_id string, line_no int, dropped array<int>")
    got = {(str(r.doc_id), r.n_lines, tuple(r.dropped)) for r in line_dedup.dropped_lines(docs).collect()}
    three = {x for x in got if x[0] == "3"}
    assert got - three == {("None", 1, (0,)), ("4", 1, ()), ("9", 1, ())}
    assert three in ({("3", 3, (1, 3)), ("3", 2, (1,))}, {("3", 3, (0, 1, 3)), ("3", 2, ())})
    kept = line_dedup.without_lines(docs)
    assert kept.columns == docs.columns and {r.text for r in kept.collect() if r.doc_id is None} == {""}


def test_shingles_of_any_characters(spark):
    """A line has one shingle for each place, also beside characters of two UTF-16 units; a short line is its own."""
    from pyspark.sql import functions as F

    from emberlog.llm import line_dedup

    texts = ["a\U0001f600bcd\U0001f600e", "\u65e5\u672c\u8a9e\u30c6\u30ad\u65e5\u672c\u8a9e\u30c6\u30ad", "abcde", "abcd", "\u00e9", "aaaaaaaa", "x abcde \U0001f600"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, norm string").select("id", line_dedup._hashes(F.col("norm")).alias("x"))
    got = {r.id: r.x for r in df.collect()}
    cut = {i: [t[k : k + 5] for k in range(max(1, len(t) - 4))] for i, t in enumerate(texts)}
    assert {i: len(x) for i, x in got.items()} == {i: len(x) for i, x in cut.items()}
    named = {(s, h) for i in cut for s, h in zip(cut[i], got[i], strict=True)}
    assert len(named) == len({s for s, _ in named}) == len({h for _, h in named})


def test_crowded_bands_against_brute_force(spark, monkeypatch):
    """One band of hundreds of clusters: every similar pair that shares it ends in one class."""
    import random

    monkeypatch.setattr(line_dedup, "BANDS", 1)
    monkeypatch.setattr(line_dedup, "ROWS", 1)
    rng = random.Random(4)
    common = "this boilerplate line of the shop says that the order was sent to its address and is on its way with number "
    lines = []
    for _ in range(300):
        line = common + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60))
        lines += [line, line[:-1] + "#"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    numbered = line_dedup.lines_of(docs, "doc_id", "text")
    ids = {r.h: r.doc_id for r in numbered.select("h", "doc_id").collect()}
    bands = defaultdict(list)
    for r in line_dedup._bands(line_dedup._signatures(numbered)).collect():
        bands[r.key].append(ids[r.node])
    want = line_clusters(lines, [p for members in bands.values() for p in combinations(sorted(members), 2)])
    assert max(map(len, bands.values())) > 100 and len(want) > 100
    assert {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.n_dropped} == want


def test_lines_of_all_lengths_share_bands(spark):
    """Short and long lines have bands of different kinds; those between have both, so that any similar pair has a kind in common."""
    import random

    rng = random.Random(21)
    lines = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)).strip() for n in range(100, 300, 2)]
    docs = spark.createDataFrame(list(enumerate([t for x in lines for t in (x, x[:-14] + x[-1], x + "".join(rng.choice("0123456789") for _ in range(len(x) // 5)))])), "doc_id long, text string")
    kinds = defaultdict(set)
    for r in line_dedup._signatures(line_dedup.lines_of(docs, "doc_id", "text")).collect():
        kinds[r.h, r.n].add(r.kind)
    long = line_dedup.LONG
    assert all(k == ({0} if n < long else {0, 1} if n < long / 0.8 else {1}) for (_, n), k in kinds.items())
    texts = [r.text for r in docs.collect()]
    pairs = [p for i in range(0, len(texts), 3) for p in combinations(range(i, i + 3), 2)]
    want = line_clusters(texts, pairs)
    got = {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.n_dropped}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


def test_bit_maps_rule_out_unlike_lines(spark, monkeypatch):
    """Lines that share a band but little else are ruled out before their texts are compared, similar ones never."""
    import random

    monkeypatch.setattr(line_dedup, "BANDS", 1)
    monkeypatch.setattr(line_dedup, "ROWS", 1)
    rng = random.Random(8)
    common = "this beginning is shared by all of them "
    lines = []
    for size in [40] * 60 + [200] * 60 + [900] * 20:
        line = common + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
        lines += [line, line[:-3] + "#" + line[-2:]]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    counts, write = defaultdict(int), line_dedup.materialize

    def counted(df, label):
        out = write(df, label)
        counts[label] += out.count()
        return out

    monkeypatch.setattr(line_dedup, "materialize", counted)
    pairs, classes = [], line_dedup.classes

    def watched(members, linked, *rest):
        return classes(members, lambda p: (pairs.append(p.count()), linked(p))[1], *rest)

    monkeypatch.setattr(line_dedup, "classes", watched)
    gone = {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.n_dropped}
    assert all(i % 2 for i in gone) and len(gone) > 60
    assert sum(pairs) > 0 and counts["near"] <= 2 * len(lines)
    found = {r.h: r.doc_id for r in line_dedup.lines_of(docs, "doc_id", "text").select("h", "doc_id").collect()}
    maps = {found[r.node]: r for r in line_dedup._bit_maps(line_dedup.lines_of(docs, "doc_id", "text").select("h", "norm")).collect()}
    cut = lambda t: {t[i : i + 5] for i in range(len(t) - 4)}
    bits = lambda x, y: bin((x ^ y) & (2**64 - 1)).count("1")
    for i, j in combinations(range(0, len(lines), 7), 2):
        a, b, unlike = maps[i], maps[j], len(cut(lines[i]) ^ cut(lines[j]))
        assert sum(bits(a[w], b[w]) for w in ("w0", "w1", "w2", "w3")) <= unlike
        assert not (a.wide and b.wide) or sum(map(bits, a.wide, b.wide)) <= unlike


def test_middling_lines_are_ruled_out_and_texts_read_once(spark, monkeypatch):
    """Bit maps tell lines of 300 characters apart, and one pass writes names and places of all lines, texts of candidates only."""
    import random

    monkeypatch.setattr(line_dedup, "BANDS", 1)
    monkeypatch.setattr(line_dedup, "ROWS", 1)
    rng = random.Random(31)
    letters = lambda size: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
    common = letters(200)
    lines = [common + letters(75) for _ in range(40)]
    lines += [lines[0][:-3] + "#" + lines[0][-2:], "alone"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    tables, write = defaultdict(list), line_dedup.materialize

    def kept(df, label):
        out = write(df, label)
        tables[label] += out.collect()
        return out

    monkeypatch.setattr(line_dedup, "materialize", kept)
    pairs, classes = [], line_dedup.classes
    monkeypatch.setattr(line_dedup, "classes", lambda members, linked, *rest: classes(members, lambda p: (pairs.append(p.count()), linked(p))[1], *rest))
    assert {r.doc_id for r in line_dedup.dropped_lines(docs).collect() if r.n_dropped} == {40}
    assert sum(pairs) >= 20 and len(tables["near"]) <= 2
    texts = {r.place.doc_id: r.norm for r in tables["named"]}
    assert len(tables["named"]) == len(lines) and texts[41] is None and texts[0] == lines[0]


def test_one_edit_in_a_line_of_sixty_bytes(spark):
    """One changed character in the middle of 60 different ones leaves 51 of 61 shingles of 5 characters: 0.84."""
    line = "".join(chr(i) for i in range(48, 65)) + "".join(chr(i) for i in range(97, 123)) + "[]_{|}~!$%&()*+,-"
    assert len(line) == len(set(line)) == 60
    near = line[:30] + "/" + line[31:]
    docs = spark.createDataFrame([(1, line), (2, near)], "doc_id long, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dropped_lines(docs).collect()} == {1: 0, 2: 1}


def test_copy_without_id_comes_first(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(None, text), (2, text), (1, text + " tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = jaccard_join.jaccard_classes(docs).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("2", 1), ("None", 1)]
