import random
import re

from loomgraph.llm.near_dedup import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n_groups=12, seed=1):
    """Chains of edits: each copy changes a word of the one before, so ends of a chain only link through its middle."""
    rng = random.Random(seed)
    docs, at = [], 0
    for _ in range(n_groups):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 40, 90, 200]))]
        for _ in range(rng.randint(1, 9)):
            docs.append((at, " ".join(words)))
            at += 1
            if rng.random() < 0.7:
                words[rng.randrange(len(words))] = f"x{rng.randrange(4000)}"
    shared = " ".join(f"s{i}" for i in range(60))
    docs += [(at + k, shared + " " + " ".join(f"u{k}_{i}" for i in range(10 + k % 4))) for k in range(30)]
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    rows = docs + [(9001, None), (9002, " \n\t "), (9003, "A b\tC"), (9004, "a B c"), (9005, "ﬁ É")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as kept", "'x' as component_id").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in near_duplicates(df).collect())


def test_odd_rows(spark):
    rows = [(None, "same text of several words here"), (2, "same text of several words here"), (2, "same text of several words here"), (5, "same TEXT of several words here")]
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("2", "2", True), ("2", "2", True), ("5", "2", False), ("None", "None", True)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rows_of_one_id_with_different_texts(spark):
    first, second = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(3, first), (5, first), (5, second), (5, second.upper()), (7, second + " more"), (2, "z " + " ".join(f"c{i}" for i in range(30))), (2, second)]
    for parts in (1, 5):
        got = {(r.doc_id, r.text_hash): (r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()}
        texts = {r.h: (r.doc_id, r.text) for r in spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "xxhash64(text) as h").collect()}
        assert sorted((d, texts[h][1][:2], *v) for (d, h), v in got.items()) == [(2, "b0", 2, True), (2, "z ", 2, True), (3, "a0", 3, True), (5, "B0", 2, False), (5, "a0", 3, False), (5, "b0", 2, False), (7, "b0", 2, False)]


def test_hot_texts_and_long_texts(spark, monkeypatch):
    from loomgraph.llm import near_dedup

    monkeypatch.setattr(near_dedup, "HOT", 20)
    long = " ".join(f"w{i}" for i in range(100_000))
    rows = [(i, "one text that many rows hold") for i in range(10, 60)] + [(1, long), (2, long + " and more"), (3, None)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 10 for i in range(10, 60)} | {1: 1, 2: 1, 3: 3}


def test_components_match_a_walk(spark):
    from loomgraph.llm.components import components

    rng = random.Random(5)
    path = [(i, i + 1) for i in range(100, 160)]
    rng.shuffle(path)
    star = [(300, i) for i in range(301, 340)] + [(i, 290) for i in range(335, 338)]
    edges = path + star + [(b, a) for a, b in star[:5]] + [(7, 7), (2, -4), (2, 9), (9, 2)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    got = sorted(tuple(r) for r in components(spark.createDataFrame(edges, "u long, v long").repartition(3)).collect())
    assert got == sorted(root.items())
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def tasks_of(spark, run):
    """The tasks that run() takes, skipped stages left out."""
    sc = spark.sparkContext
    sc.setJobGroup("counted", "counted")
    try:
        run()
        tracker = sc.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("counted") for s in tracker.getJobInfo(job).stageIds}
        return sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))
    finally:
        sc._jsc.clearJobGroup()


def test_a_run_takes_few_tasks(spark):
    """With many partitions of few rows the tasks themselves are the cost. Texts are met once, and a component that is settled costs no further round."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in held}
    docs = spark.createDataFrame(corpus(6, 3), "doc_id long, text string").repartition(3)
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        tasks = tasks_of(spark, lambda: near_duplicates(docs).write.format("noop").mode("overwrite").save())
        assert 0 < tasks < 2500
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
