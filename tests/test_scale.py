"""The work of operators on larger inputs: how often they read, what they exchange, and that forms of one step agree."""

import io
import os
import random
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.operators import cluster, diagnose, graph, hierarchy, metrics


def plan(df) -> str:
    """The plan as it is before it runs."""
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_a_fit_reads_the_pairs_once(spark):
    """F11, F16"""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rng = random.Random(3)
    rows = [(rng.randint(-8, 8) / 4, int(rng.random() < 0.4)) for _ in range(400)]
    df = spark.createDataFrame(rows, "logit double, label int").mapInArrow(count, "logit double, label int")
    got = diagnose.fit_temperature(df)
    assert seen.value == 400

    def loss(t):
        return sum(max(z / t, 0) - z / t * y + np.log1p(np.exp(-abs(z / t))) for z, y in rows)

    assert loss(got) <= min(loss(np.exp(-v)) for v in np.linspace(-6, 6, 400)) + 1e-6
    seen.value = 0
    record = diagnose.temperature_record(df, "validation", "pairs").first()
    assert seen.value == 400 and record["temperature"] == got and record["num_pairs"] == 400 and abs(record["pos_rate"] - sum(y for _, y in rows) / 400) < 1e-12


def test_a_threshold_curve_needs_no_join_or_window(spark):
    """F22"""
    rng = random.Random(5)
    rows = [(rng.randint(0, 5), rng.choice([None, *[k / 10 for k in range(11)]]), rng.randint(0, 1)) for _ in range(300)]
    df = spark.createDataFrame(rows, "topic int, p double, label int")
    taus = diagnose.grid(0.1, 0.9, 0.1)
    curve = diagnose.tau_curve(df, taus, ["topic"])
    assert "Window" not in plan(curve) and "Join" not in plan(curve)
    want = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        for tau in taus:
            hit = [r for r in own if r[1] is not None and r[1] >= tau]
            tp = sum(r[2] for r in hit)
            want[t, tau] = (tp, len(hit) - tp, sum(r[2] for r in own) - tp)
    assert {(r["topic"], r["tau"]): (r["tp"], r["fp"], r["fn"]) for r in curve.collect()} == want
    assert diagnose.tau_curve(df.limit(0), taus).count() == 0


def test_components_of_topics_go_in_one_exchange(spark, monkeypatch):
    """no rounds for topics that a task holds; large ones, cut chunks and other types of keys give the same labels."""
    rng = random.Random(11)
    sizes = {t: rng.choice([1, 2, 5, 40]) for t in range(60)}
    nodes = [(t, i * 3) for t, n in sizes.items() for i in range(n)]
    edges = [(t, rng.randrange(n) * 3, rng.randrange(n) * 3) for t, n in sizes.items() for _ in range(n // 2)] + [(0, None, 0)]
    n = spark.createDataFrame(nodes, "topic int, idx long")
    e = spark.createDataFrame(edges, "topic int, i long, j long")
    want = {}
    for t, size in sizes.items():
        root = list(range(size))
        for _, i, j in [x for x in edges if x[0] == t and x[1] is not None]:
            a, b = sorted((root[i // 3], root[j // 3]))
            root = [a if r == b else r for r in root]
        order = sorted(set(root))
        want |= {(t, i * 3): order.index(root[i]) for i in range(size)}
    rows = lambda df: {(r["topic"], r["idx"]): r["label"] for r in df.collect()}

    rounds = []
    spread = graph.connected_components
    monkeypatch.setattr(graph, "connected_components", lambda *a, **b: rounds.append(1) or spread(*a, **b))
    assert rows(graph.components_by_topic(n, e)) == want and not rounds
    names = lambda df, *cs: df.select(F.struct(F.col("topic").cast("string").alias("a"), F.lit(0.5).alias("b")).alias("topic"), *[F.lpad(F.col(c).cast("string"), 4, "0").alias(c) for c in cs])
    got = graph.components_by_topic(names(n, "idx"), names(e, "i", "j"))
    assert {(int(r["topic"]["a"]), int(r["idx"])): r["label"] for r in got.collect()} == want
    monkeypatch.setattr(graph, "WHOLE", 20)
    assert rows(graph.components_by_topic(n, e)) == want and rounds


def test_components_are_held_in_chunks(monkeypatch):
    """A topic of more rows than a chunk is kept as its stars."""
    import pyarrow as pa

    monkeypatch.setattr(graph, "CHUNK", 8)
    rng = random.Random(2)
    rows = []
    for t in range(6):
        k = rng.choice([3, 30])
        own = [(t, i, None, False) for i in range(k)] + [(t, *sorted(rng.sample(range(k), 2)), True) for _ in range(3 * k if k > 3 else 1)]
        rng.shuffle(own)
        rows += own
    schema = pa.schema([("topic", pa.int64()), ("i", pa.int64()), ("j", pa.int64()), ("edge", pa.bool_())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[k : k + 5]], schema) for k in range(0, len(rows), 5)]
    got = {(r["topic"], r["idx"]): r["label"] for b in graph._labels(iter(batches)) for r in b.to_pylist()}
    for t in range(6):
        nodes = sorted(r[1] for r in rows if r[0] == t and not r[3])
        root = {i: i for i in nodes}
        for _, i, j, _ in [r for r in rows if r[0] == t and r[3]]:
            a, b = sorted((root[i], root[j]))
            root = {k: a if r == b else r for k, r in root.items()}
        order = sorted(set(root.values()))
        assert [got[t, i] for i in nodes] == [order.index(root[i]) for i in nodes]


def test_candidates_are_no_pairs(spark):
    """relations from one cluster, with and without mentions, to many; rows of the joins grow as they do."""
    k = 60
    edges = [(0, "r", f"n{i}") for i in range(2)] + [(0, f"n{i}", f"s{i}{j}") for i in range(2) for j in range(k)]
    gold = spark.createDataFrame(edges, "topic int, src string, dst string")
    m = spark.createDataFrame([(0, x, x) for x in {e[2] for e in edges}], "topic int, cluster string, mention string")
    table = hierarchy.hypernym50(gold, gold.where("src <> 'n1'"), m, m)
    row = hierarchy.micro(table).first()
    # direct and derived relations: 2 + 4k of gold, 2 + 2k of the system; those below n1 have no match
    assert (row["gold"], row["gold_hit"], row["sys"], row["sys_hit"]) == (2 + 4 * k, 2 + 2 * k, 2 + 2 * k, 2 + 2 * k)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert _most_joined(hierarchy.hypernym50(gold, gold.where("src <> 'n1'"), m, m)) <= 3 * (2 + 4 * k)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def _most_joined(df) -> int:
    """Rows of the largest join of a plan that is run."""
    ran = df._jdf.queryExecution().executedPlan()
    ran.executeCollect()
    most, left = 0, [ran]
    while left:
        node = left.pop()
        if "Join" in node.nodeName():
            rows = node.metrics().get("numOutputRows")
            most = max(most, rows.get().value() if rows.isDefined() else 0)
        kids = node.children()
        left += [kids.apply(i) for i in range(kids.size())]
    return most


def test_many_topics_are_merged_as_each_is():
    """F9"""
    rng = np.random.default_rng(1)
    for linkage in ("average", "complete"):
        for n in (1, 2, 3, 7):
            d = np.round(rng.random((40, n, n)), 1)  # with ties
            d = (d + d.transpose(0, 2, 1)) / 2
            steps = cluster.merges_of_many(d, linkage)
            for x in (0.2, 0.5, 2.0):
                assert [list(r) for r in cluster.cut_many(steps, x)] == [cluster.cut(n, cluster.merges(m, linkage), x) for m in d]


def test_small_topics_make_no_call_each(spark, monkeypatch):
    """The agglomeration of small topics has no step a topic, larger ones and carried columns come with it."""
    rng = random.Random(4)
    sizes = {t: rng.choice([1, 2, 4, 6]) for t in range(50)} | {99: cluster.SMALL + 3}
    nodes = [(t, 5 * i, f"{t}-{i}") for t, n in sizes.items() for i in range(n)]
    pairs = [(t, 5 * i, 5 * j, round(rng.random(), 2)) for t, n in sizes.items() for i in range(n) for j in range(i + 1, n) if rng.random() < 0.9]
    rng.shuffle(nodes)
    rng.shuffle(pairs)
    got = cluster.agglomerate(spark.createDataFrame(nodes, "topic int, idx long, name string"), spark.createDataFrame(pairs, "topic int, i long, j long, p double"), [0.3, 0.6], "complete").collect()
    assert len(got) == 2 * len(nodes) and all(r["name"] == f"{r['topic']}-{r['idx'] // 5}" for r in got)
    for t, n in sizes.items():
        d = np.ones((n, n))
        for _, i, j, p in [x for x in pairs if x[0] == t]:
            d[i // 5, j // 5] = d[j // 5, i // 5] = 1 - p
        for x in (0.3, 0.6):
            assert [r["label"] for r in sorted(got, key=lambda r: r["idx"]) if r["topic"] == t and r["threshold"] == x] == cluster.cut(n, cluster.merges(d, "complete"), x)
    import pyarrow as pa

    calls = []
    monkeypatch.setattr(cluster, "merges", lambda *a: calls.append(a))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([[{"idx": 0}, {"idx": 1}], [{"idx": 4}]]), pa.array([[{"i": 0, "j": 1, "p": 0.9}], []], pa.list_(pa.struct([("i", pa.int64()), ("j", pa.int64()), ("p", pa.float64())])))], ["topic", "idx", "edges"])
    assert sum(b.num_rows for b in cluster._cluster([0.5], "average", [])(iter([batch]))) == 3 and not calls


def test_a_document_s_cells_meet_once(spark):
    """One exchange for the counts of cells and one for their document, the same for both sides, then one of the sums."""
    a = spark.createDataFrame([(1, 0, 1, 2), (1, 1, None, 2), (2, 0, 1, None)], "doc int, mention int, key int, sys int").withColumn("doc", F.struct(F.lit(1).alias("at"), "doc"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        text = plan(metrics.evaluate(a, ("b3",), by="at").where("at > 0"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    made = [line for line in text.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(made) <= 3 and "ReusedExchange" in text, text


def test_narrow_assignments(spark, monkeypatch):
    """documents of few clusters are solved without a call each, and as the solver does."""
    rng = np.random.default_rng(8)
    for h, w in ((1, 1), (3, 2), (3, 3), (7, 5)):
        gain = rng.random((20, h, w)) * (rng.random((20, h, w)) < 0.7)
        assert np.allclose(metrics.best_of_many(gain), [metrics.best_assignment(g) for g in gain])
    rows = [(d, i, int(rng.integers(0, k)) if rng.random() < 0.9 else None, int(rng.integers(0, k)) if rng.random() < 0.9 else None) for d, k in enumerate((1, 3, 4, 9, 3)) for i in range(24)]
    rows += [(90, 0, 1, None), (91, 0, None, 1)]
    a = spark.createDataFrame(rows, "doc int, mention int, key int, sys int").where("key is not null or sys is not null")
    narrow = {r["doc"]: r.asDict() for r in metrics.ceaf_sums(a).collect()}
    text = a.selectExpr("doc", "mention", "concat('k', key) as key", "named_struct('x', sys) as sys").withColumn("sys", F.when(F.col("sys.x").isNotNull(), F.col("sys")))
    wide = {r["doc"]: r.asDict() for r in metrics.ceaf_sums(text).collect()}
    assert set(narrow) == set(wide) == {0, 1, 2, 3, 4, 90} and narrow[90]["ceafm_num"] == 0
    for d in narrow:
        cells = np.zeros((9, 9))
        for _, _, k, s in [r for r in rows if r[0] == d and None not in r[2:]]:
            cells[k, s] += 1
        sizes = [[sum(r[c] == k for r in rows if r[0] == d) for k in range(9)] for c in (2, 3)]
        phi4 = 2 * cells / np.maximum(1, np.add.outer(*map(np.array, sizes)))
        for got in (narrow[d], wide[d]):
            assert abs(got["ceafm_num"] - metrics.best_assignment(cells)) < 1e-9 and abs(got["ceafe_num"] - metrics.best_assignment(phi4)) < 1e-9
            assert (got["clusters_r"], got["clusters_p"]) == tuple(sum(x > 0 for x in s) for s in sizes)


def _query_plan(spark, tmp_path, name) -> str:
    from clusterloom.plans.queries import QUERIES

    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(1, "s", "Big net reads Text. big net again")], "doc_id long, source string, text string").write.mode("overwrite").parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    return QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()


def test_extractions_are_made_without_patterns(spark, tmp_path):
    """a sentence's 48 words are cleaned by translation; only the paragraphs and the brackets need patterns."""
    text = _query_plan(spark, tmp_path, "bracket_mentions")
    assert "(?U)" not in text and text.count("regexp_replace(") <= 3


def test_a_query_extracts_what_it_needs(spark, tmp_path):
    """the texts are read once, with one pass of the bracket pattern for each thing that is used, and names make no rows of a join."""
    for name, passes in (("exact_recall", 1), ("incoming_relations", 2)):
        text = _query_plan(spark, tmp_path, name)
        assert (text.count("regexp_extract_all("), text.count("Relation "), text.count("Join ")) == (passes, 1, 0), name


def test_neighbours_are_sorted_once_a_sentence(spark, tmp_path):
    """F12, F4, F5"""
    for name in ("co_mentions", "signature_fields"):
        text = _query_plan(spark, tmp_path, name)
        assert text.count("regexp_extract_all(") == 1  # mention, type and relations come from one pass
        assert "array_sort(" not in text and "sort_array(transform(" in text, name


def test_spans_meet_paragraphs_in_one_join(spark):
    """windows are no rows, and odd texts give what all windows give."""
    from clusterloom.functions import text as T
    from clusterloom.operators import align

    rng = random.Random(6)
    words = ["a", "A", "b", ",", "(", ")", "", "İ", "ß", "’s", "x y", "ab", ". "]
    paras = [(k, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for k in range(40)]
    targets = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 3)))) for k in range(40) for _ in range(4)]
    p = spark.createDataFrame(paras, "id int, tokens array<string>")
    t = spark.createDataFrame(targets, "id int, target string")
    found = align.find_spans(p, t, ["id"], 5)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    part = F.slice("tokens", F.col("start") + 1, F.col("end") - F.col("start"))
    every = p.select("id", "tokens", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("start")).where("start < size(tokens)")
    every = every.select("*", F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + 5, F.size("tokens")))).alias("end")).withColumn("gram", T.norm(T.detok(part)))
    wanted = t.distinct().withColumn("gram", T.norm("target")).where("gram <> ''")
    begins = F.startswith(F.col("gram"), F.translate(F.lower(F.get("tokens", F.col("start"))), "‘’“”", "''\"\""))
    same = F.char_length(F.replace(F.lower(F.array_join(part, "")), F.lit(" "), F.lit(""))) == F.char_length(F.replace("gram", F.lit(" "), F.lit("")))
    want = every.join(wanted, ["id", "gram"]).where(begins & same).groupBy("id", "target", "start").agg(F.min("end").alias("end"))
    rows = lambda df: sorted(map(tuple, df.select("id", "target", "start", "end").collect()))
    assert rows(found) == rows(want) and len(rows(want)) > 20


def test_long_texts_are_joined_as_short_ones(spark):
    """Searches for strings and patterns give the same text, with any white space."""
    import re

    from clusterloom.functions import text as T

    rng = random.Random(9)
    words = ["a", "wörd", ",", ".", "(", ")", "[", "]", "%", ";", ":", "[x", "y,"]
    odd = [*words, " ", "　.", " ", "( ", " ,", "\t", "x ("]
    rows = [([rng.choice(odd if k % 3 else words) for _ in range(rng.choice([3, 60]))],) for k in range(150)]
    df = spark.createDataFrame(rows, "t array<string>")
    space = r"[\t\n\x0b\f\r \x85\xa0  -     　]+"
    tight = lambda s: re.sub(r"([\[(])" + space, r"\1", re.sub(space + r"([,.;:%)\]])", r"\1", s))
    for r in df.select("t", T.detok(F.col("t")).alias("d"), T.highlight(F.col("t"), F.lit(1), F.lit(2), F.lit(0), F.size("t")).alias("h")).collect():
        t = r["t"]
        assert r["d"] == tight(" ".join(t))
        marked = " ".join([" ".join(t[:1]), "<m>", t[1], "</m>", " ".join(t[2:])])
        assert r["h"] == tight(" ".join(re.split(space, re.sub(f"^{space}|{space}$", "", marked))))


def test_odd_brackets_in_one_pass(spark):
    """mention, type and relations are what the pattern's groups hold."""
    from clusterloom.functions import text as T

    rng = random.Random(12)
    rows = [("".join(rng.choice(["[", "]", "|", " ", "a", "b =", "=c", "\n", "[ a | b | ", "| c = d ]", "é", " "]) for _ in range(rng.randint(1, 14))),) for _ in range(600)]
    part = lambda i: F.regexp_extract_all("t", F.lit(T._ENTITY), F.lit(i))
    got = spark.createDataFrame(rows, "t string").select("t", part(1).alias("a"), part(2).alias("b"), F.transform(part(3), T.parse_relations).alias("c"), T.parse_entities(F.col("t")).alias("e")).collect()
    assert sum(len(r["e"]) for r in got) > 150
    for r in got:
        assert [(e["text"], e["type"], e["rels"]) for e in r["e"]] == [(a.strip(), b.strip() or None, c) for a, b, c in zip(r["a"], r["b"], r["c"], strict=True)], r["t"]


def test_cards_parse_a_sentence_once(spark, tmp_path):
    """no filter of the generator parses the texts again."""
    assert _query_plan(spark, tmp_path, "signature_cards").count("regexp_extract_all(") == 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_annotation_files_are_read_once(spark):
    """what is scored comes from tables, not from the files again for each use."""
    from clusterloom.plans.queries import QUERIES

    df = QUERIES["file_scores"](spark, "/root/testdata/sf0.001")
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    kinds = {leaves.apply(k).toString().split()[-1] for k in range(leaves.size())}
    assert kinds == {"parquet"}
