import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clusterloom.functions import text as T
from clusterloom.operators import align, cluster, diagnose, graph, hierarchy, metrics, pairs, score
from clusterloom.plans import commands
from clusterloom.sources import conll, jsonl, markables
from clusterloom.streaming import ingest


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_text(spark):
    assert one(spark, T.detok(F.col("t")), t=["a", "(", "b", ")", ",", "c", "%", "."]) == "a (b), c%."
    assert one(spark, T.norm(F.col("t")), t="  “A”  b’s ") == "\"a\" b's"
    got = one(spark, T.parse_entities(F.col("t")), t="x [ a b | kind | used for = c = d |  = e ] y [ 12 ] [ f |  ]")
    assert [(e["text"], e["type"], [(r["pred"], r["obj"]) for r in e["rels"]]) for e in got] == [("a b", "kind", [("used for", "c = d")]), ("f", None, [])]
    named = T.parse_named(F.col("t"))
    text = "a [ deep model | method | used for = Chemical; part_of = nothing ] for [ chemical | term ] and [ chemical | other | compare = deep model ]"
    got = one(spark, named, t=text)
    assert [(e["text"], e["type"], [tuple(r) for r in e["rels"]]) for e in got] == [("deep model", "method", [("for", "Chemical"), ("part_of", "nothing")]), ("chemical", "term", []), ("chemical", "other", [("compare", "deep model")])]
    assert [tuple(r) for r in one(spark, T.link_entities(named), t=text)] == [(0, "for", 1, "Chemical"), (0, "part_of", None, "nothing"), (1, "compare", 0, "deep model")]
    span = align.first_span(F.col("t"), F.lit("B ,"))
    assert one(spark, span, t=["a", "b", "b", ",", "c"]) is None and tuple(one(spark, align.first_span(F.col("t"), F.lit("B,")), t=["a", "b", "b", ",", "c"])) == (2, 4)
    assert one(spark, T.highlight(F.col("t"), F.lit(1), F.lit(2), F.lit(0), F.lit(4)), t=["a", "b", ",", "c"]) == "a <m> b </m>, c"
    assert one(spark, T.bracket_mentions(F.col("t")), t="[ a | k ] [ b ]") == ["a", "b"]


def brute_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(-50, 50), random.randint(-50, 50)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    df = spark.createDataFrame(edges + [(None, 3)], "src long, dst long")
    got = {r["node"]: r["component"] for r in graph.connected_components(df).collect()}
    want = brute_components({n for e in edges for n in e}, edges)
    assert got == {n: c for n, c in want.items() if n in got} and all(want[n] == n and n not in got or n in got for n in want if any(a != b and n in (a, b) for a, b in edges))
    assert graph.connected_components(df.limit(0)).count() == 0


def test_closure_with_a_cycle(spark):
    edges = [(0, "a", "b"), (0, "b", "c"), (0, "c", "a"), (0, "c", "d"), (1, "a", "b")]
    got = {tuple(r) for r in graph.closure(spark.createDataFrame(edges, "topic int, src string, dst string")).collect()}
    assert {(t, a, b) for t, a, b, _ in got} == {(0, x, y) for x in "abc" for y in "abcd"} | {(1, "a", "b")}
    assert (0, "a", "d", 3) in got and (0, "a", "a", 3) in got


def test_hypernym(spark):
    m = spark.createDataFrame([(0, c, c.upper()) for c in "abc"], "topic int, cluster string, mention string")
    gold = spark.createDataFrame([(0, "a", "b"), (0, "a", "b"), (0, "b", "c")], "topic int, src string, dst string")
    sys = spark.createDataFrame([(0, "a", "b")], "topic int, src string, dst string")
    r = hierarchy.micro(hierarchy.hypernym(gold, sys, m, m)).first()
    assert (r["gold"], r["gold_hit"], r["sys"], r["sys_hit"]) == (4, 2, 1, 1)
    r = hierarchy.micro(hierarchy.hypernym50(gold, sys, m, m)).first()
    assert (r["gold"], r["gold_hit"], r["sys"], r["sys_hit"]) == (3, 1, 1, 1)
    r = hierarchy.path_ratio(gold, sys, m, m).first()
    assert (r["total"], r["pairs"]) == (4.0, 6)


def naive_labels(d, t, linkage):
    groups = [[i] for i in range(len(d))]
    while len(groups) > 1:
        best = min(((np.mean if linkage == "average" else np.max)([d[i][j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y)
        if best[0] >= t:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_agglomeration():
    rng = np.random.default_rng(0)
    for linkage in ("average", "complete"):
        for _ in range(30):
            n = int(rng.integers(1, 8))
            d = rng.random((n, n))
            d = (d + d.T) / 2
            labels = cluster.cut(n, cluster.merges(d, linkage), 0.5)
            assert {frozenset(i for i in range(n) if labels[i] == k) for k in set(labels)} == naive_labels(d, 0.5, linkage)


def test_cells(spark):
    tokens = spark.createDataFrame([("d", i) for i in range(6)], "doc string, pos int")
    spans = spark.createDataFrame([("d", 0, 3, 1), ("d", 1, 2, 1), ("d", 5, 5, 10043), ("d", 4, 4, 2)], "doc string, start int, end int, cluster long")
    cells = conll.encode(tokens, spans)
    assert [r["cell"] for r in cells.orderBy("pos").collect()] == ["(1", "(1", "1)", "1)", "(2)", "(10043)"]
    assert {tuple(r) for r in conll.decode(cells).collect()} == {tuple(r) for r in spans.collect()}
    odd = spark.createDataFrame([("d", 0, "1)"), ("d", 1, "(1"), ("d", 2, "-")], "doc string, pos int, cell string")
    assert conll.decode(odd).count() == 0


def test_signature_cards(spark, tmp_path):
    import yaml

    from clusterloom.plans.queries import QUERIES

    spark.createDataFrame([(1, "s", "Big net reads Text. big net again"), (2, "s", "one")], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["doc"], r["ord"]): yaml.safe_load(r["signature"]) for r in QUERIES["signature_cards"](spark, str(tmp_path)).collect()}
    assert len(got) == 16
    assert got[1, 0] == {
        "mention": "net reads",
        "type": "method",
        "outgoing": [{"pred": "part of", "obj": "Text"}, {"pred": "used for", "obj": "."}],
        "incoming": [{"pred": "used for", "subject": "x x"}],
        "co_mentions": [{"text": "net", "type": "task"}, *[{"text": "x", "type": "task"}] * 3, {"text": "x x"}, {"text": "x x"}],
        "context": "Big <m> net reads </m> Text. big net again",
    }
    assert got[1, 1]["context"] == "Big <m> net </m> reads Text. big net again" and got[1, 1]["incoming"] == []
    assert got[1, 3]["outgoing"] == [{"pred": "compare", "obj": "net = x"}] and got[2, 1]["context"] == "one"


def test_decoding_against_a_stack(spark):
    r = random.Random(7)
    rows = [(d, i, "|".join(r.choice(("(1", "1)", "(2", "2)", "(1)", "(2)")) for _ in range(r.randint(1, 3))) if r.random() < 0.7 else "-") for d in range(40) for i in range(12)]
    want = []
    for d in range(40):
        held = {"1": [], "2": []}
        for _, i, cell in [x for x in rows if x[0] == d]:
            marks = [m for m in cell.split("|") if m != "-"]
            want += [(d, i, i, int(m[1])) for m in marks if len(m) == 3]
            for m in [m for m in marks if m in ("(1", "(2")]:
                held[m[1]].append(i)
            for m in [m for m in marks if m in ("1)", "2)")]:
                if held[m[0]]:
                    want.append((d, held[m[0]].pop(), i, int(m[0])))
    got = conll.decode(spark.createDataFrame(rows, "doc long, pos long, cell string"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_conll_files(spark, tmp_path):
    (tmp_path / "x.conll").write_text("#begin document (a); part 0\na\t0\t0\tw\t(1\n\n\na\t0\t1\tv\t1)\n#end document\n")
    got = [(r["sent"], r["pos"], r["cell"]) for r in conll.read(spark, str(tmp_path)).orderBy("pos").collect()]
    assert got == [(0, 0, "(1"), (1, 1, "1)")]
    cells = spark.createDataFrame([("d", 0, "w", "(1)"), ("d", 1, "v", "-")], "doc string, pos int, word string, cell string")
    conll.write(cells, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "#begin document d\n0\td\t0\tw\t(1)\n1\td\t1\tv\t-\n#end document\n"
    many = spark.createDataFrame([(f"d{i % 7}", i // 7, i % 3, i, "w", f"({i % 5})") for i in range(700)], "doc string, pos int, doc_id int, token_id int, word string, cell string")
    conll.write(many.repartition(5), str(tmp_path / "many"))
    back = conll.read(spark, str(tmp_path / "many"))
    assert sorted((r["doc"], r["pos"], *r["columns"][1:3], r["cell"]) for r in back.collect()) == sorted((f"d{i % 7}", i // 7, str(i % 3), str(i), f"({i % 5})") for i in range(700))


def test_parse_column(spark, tmp_path):
    line = "d\t0\t{}\tw\tNN\t{}\t-\t(1)\n"
    (tmp_path / "x.conll").write_text("#begin document a\n" + line.format(0, "(NP*)") + "#end document\n#begin document b\n" + line.format(0, "-") + line.format(1, "(NP*)") + "#end document\n#begin document c\nc\t(1)\n#end document\n")
    assert {tuple(r) for r in conll.has_parse(conll.read(spark, str(tmp_path))).collect()} == {("a", True), ("b", False), ("c", False)}


def cell_by_hand(cell):
    """Marks of a cell, one character at a time."""
    out, digits, opened = [], "", False
    for c in [*cell, "|"]:
        if c.isdigit():
            digits += c
        elif c == "(":
            digits, opened = "", True
        elif c in ")|":
            if digits and (opened or c == ")"):
                out.append((int(digits), opened, c == ")"))
            digits, opened = "", False
    return out


def test_odd_cells(spark):
    r = random.Random(3)
    cells = ["(1)(2)", "(1(2)", "1)(2", "1)2)", "()(3", "(1|2)", "*", "-", "", "((4)", "(5x)|6)"]
    cells += ["".join(r.choice("()|12x") for _ in range(r.randint(1, 9))) for _ in range(300)]
    cells = [c for c in cells if "(|" not in c]  # an open mark without a number is an error
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").select("i", conll.cell_marks(F.col("c")).alias("m")).collect()
    assert {r["i"]: [tuple(m) for m in r["m"]] for r in got} == {i: cell_by_hand(c) for i, c in enumerate(cells)}


def test_markables(spark, tmp_path):
    (tmp_path / "a.CONLL").write_text(
        "TOKEN  MARKABLES MIN TAG\n"
        "w0\tB-markable_1=set_7\tnon_referring\n"  # three columns: the last one is the tag
        "w1 B-markable_2=set_8@B-markable_3=set_7  word_2..word_3@  referring@non_referring\n"
        "w2 I-markable_2=set_9@I-markable_3=set_7  word_1@word_1  non_referring@referring\n"
        "w3\n"
        "w4 B-markable_4=set_7 word_5 x referring\n"
    )
    marks = markables.markables(markables.read_lines(spark, str(tmp_path)))
    got = {tuple(r)[1:] for r in marks.collect()}
    assert got == {(1, "7", 0, 0, 0, 0, False), (2, "8", 1, 2, 1, 2, True), (3, "7", 1, 2, 1, 2, False), (4, "7", 4, 4, 4, 4, False)}
    refer, other = markables.split_referring(marks)
    assert {r["markable"] for r in refer.collect()} == {2} and {r["markable"] for r in other.collect()} == {1}


def test_nested_mentions_count_each_removal(spark):
    rows = [("three", "c", 1, 0, 9), ("three", "c", 2, 1, 8), ("three", "c", 3, 2, 7), ("two", "c", 1, 0, 9), ("two", "c", 2, 1, 8), ("own", "c", 1, 0, 1), ("own", "c", 2, 3, 4)]
    m = spark.createDataFrame(rows, "doc string, cluster string, id int, start int, end int")
    kept = lambda keep: {(r["doc"], r["id"]) for r in align.drop_nested(m, keep).collect()}
    # three inside each other: three removals for three mentions, so the rule for a lone mention does not hold
    assert kept(True) == {("three", 1), ("two", 1), ("two", 2), ("own", 1), ("own", 2)} and kept(False) == {("three", 1), ("own", 1), ("own", 2)}


def test_aligned_mentions(spark):
    schema = "doc string, start int, end int, cluster int"
    key = spark.createDataFrame([("a", 0, 0, 1), ("a", 2, 3, 1), ("a", 2, 3, 5), ("b", 0, 1, 2)], schema)
    sys = spark.createDataFrame([("a", 0, 0, 9), ("a", 5, 5, 9), ("c", 0, 0, 1)], schema)
    docs = lambda *names: spark.createDataFrame([(n,) for n in names], "doc string")
    got = {(r["doc"], tuple(r["mention"]), r["key"], r["sys"]) for r in metrics.align_mentions(key, sys, docs("a", "b"), docs("a", "c"), "skip").collect()}
    assert got == {("a", (0, 0), 1, 9), ("a", (2, 3), 5, None), ("a", (5, 5), None, 9)}
    with pytest.raises(Exception, match="no document b"):
        metrics.align_mentions(key, sys, docs("a", "b"), docs("a")).collect()
    seen = metrics.mask_unseen(key, sys, keep_singletons=False)
    assert seen.count() == 0 and metrics.mask_unseen(key, sys).count() == 1


def test_commands(spark, tmp_path):
    def put(name, cells):
        (tmp_path / name).write_text("#begin document (d)\n" + "".join(f"d\t0\t{i}\tw\t{c}\n" for i, c in enumerate(cells)) + "#end document\n")
        return str(tmp_path / name)

    key, sys = put("key", ["(1)", "(2)", "(2)", "(3", "(3)", "3)", "(3)"]), put("sys", ["(1)", "-", "-", "(3)", "(3)", "-", "-"])
    rows = {r["metric"]: tuple(round(r[c], 6) for c in ("recall", "precision")) for r in commands.score_files(spark, key, sys).collect()}
    assert set(rows) == set(metrics.REGISTRY) and rows["mention"] == (round(2 / 6, 6), round(2 / 3, 6))
    no_singletons = commands.score_files(spark, key, sys, **commands.score_options(["bcub", "remove_singletons", "muc", "x"]))
    assert {r["metric"] for r in no_singletons.collect()} == {"muc", "b3"}
    assert commands.score_options([]) == {"metric_names": "all", "remove_nested": False, "keep_singletons": True}
    nested = commands.mentions_of(conll.read(spark, key), remove_nested=True)
    assert {(r["start"], r["end"]) for r in nested.where("cluster = 3").collect()} == {(3, 5), (6, 6)}
    lines = [r["line"] for r in metrics.report(commands.score_files(spark, key, key, ("muc", "b3"))).collect()]
    assert lines == ["b3         Recall: 100.00  Precision: 100.00  F1: 100.00", "muc        Recall: 100.00  Precision: 100.00  F1: 100.00"]
    assert commands.conll_line(commands.score_files(spark, key, key)).first()["line"] == "CoNLL score: 100.00"
    m = spark.createDataFrame([(t, i, i % 2, "a b c" if i % 2 else "x y") for t in (1, 2, 3) for i in range(4)], "topic int, idx long, cluster int, signature string")
    assert {r["topic"] for r in commands.training_pairs(m, topics_limit=2).collect()} == {1, 2}
    assert {tuple(r["clusters"]) for r in commands.predict_clusters(m, score.lexical_scorer).collect()} == {(0, 1, 0, 1)}
    scored = spark.createDataFrame([(t, i, j, 0.9 if (i + j) % 2 == 0 else 0.1) for t in (1, 2, 3) for j in range(4) for i in range(j)], "topic int, i long, j long, p double")
    swept = commands.sweep_thresholds(m.select("topic", "idx"), scored, m.select("topic", "idx", F.col("cluster").alias("gold")), t_min=0.2, t_max=0.8, t_step=0.3)
    assert cluster.winner(swept, "conll").first()["threshold"] == 0.2 and swept.count() == 3


def test_prediction_checks(spark):
    topics = spark.createDataFrame([(1, [(0, 1, 2), (0, 4, 5)]), (2, [(0, 1, 2)])], "topic int, mentions array<struct<para:int,start:int,end:int>>")
    good = spark.createDataFrame([(1, [7, 8])], "topic int, clusters array<int>")
    assert [tuple(m) for m in cluster.system_topics(topics, good).first()["mentions"]] == [(0, 1, 2, 7), (0, 4, 5, 8)]
    assert cluster.system_topics(topics, good, skipped=True).first()["topic"] == 2
    with pytest.raises(Exception, match="topic 2: 3 clusters for 1 mentions"):
        cluster.system_topics(topics, spark.createDataFrame([(2, [1, 2, 3])], "topic int, clusters array<int>")).collect()
    rows = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    assert align.require(rows, rows.select("k", F.lit(1).alias("n")), ["k"], "row").count() == 2
    with pytest.raises(Exception, match="no row for k 2"):
        align.require(rows, rows.where("k = 1").select("k"), ["k"], "row").collect()


def test_records_and_registry(spark, tmp_path):
    record = spark.createDataFrame([(1.5, "validation", 10, None)], "temperature double, split string, num_pairs long, scores_path string")
    jsonl.write_record(record, str(tmp_path / "t"))
    assert jsonl.read_record(spark, str(tmp_path / "t")) == {"temperature": 1.5, "split": "validation", "num_pairs": 10, "scores_path": None}
    jsonl.write(record, str(tmp_path / "all" / "validation.jsonl"))
    assert jsonl.scan_split(spark, str(tmp_path / "all"), "dev", record.schema).count() == 1
    jsonl.write_csv(record, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).first()["split"] == "validation"
    with pytest.raises(ValueError, match="no metric"):
        metrics.chosen(("muc", "blanc"))
    assert metrics.chosen("all") == tuple(metrics.REGISTRY)
    with pytest.raises(ValueError, match="no pairs"):
        diagnose.temperature_record(spark.createDataFrame([], "logit double, label int"), "validation", "x")


def test_dendrograms_against_plain_search(spark):
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 8, 25):
        for linkage in ("average", "complete"):
            d = r.integers(0, 16, (n, n)) / 16 if linkage == "complete" else r.random((n, n))
            d = np.maximum(d, d.T)
            members = {i: [i] for i in range(n)}
            want = []
            fold = np.mean if linkage == "average" else np.max
            while len(members) > 1:
                dist, a, b = min((round(float(fold(d[np.ix_(members[a], members[b])])), 9), a, b) for a in members for b in members if a < b)
                want.append((dist, a, b))
                members[a] += members.pop(b)
            assert [(round(x, 9), a, b) for x, a, b in cluster.merges(d, linkage)] == want, (n, linkage)


def test_labels_of_all_thresholds(spark):
    nodes = spark.createDataFrame([(t, i) for t in (1, 2) for i in range(4)], "topic int, idx long")
    scored = spark.createDataFrame([(t, i, j, (i + 2 * j + t) % 7 / 7) for t in (1, 2) for j in range(4) for i in range(j)], "topic int, i long, j long, p double")
    for method in ("cc", "agglomerative"):
        got = {tuple(r[c] for c in ("threshold", "topic", "idx", "label")) for r in cluster.labels_at(nodes, scored, [0.3, 0.6], method).collect()}
        assert got == {(t, r["topic"], r["idx"], r["label"]) for t in (0.3, 0.6) for r in cluster.cluster(nodes, scored, method, t).collect()}
    rows = spark.createDataFrame([(0.2, 0.5), (0.3, 0.7), (0.4, 0.7)], "threshold double, f1 double")
    assert cluster.winner(rows, "f1").first()["threshold"] == 0.3 and cluster.winner(rows.limit(0), "f1").count() == 0


def test_scorer_of_a_function_and_a_saved_one(spark, tmp_path):
    rows = spark.createDataFrame([(i, "a b c", "a b" if i % 2 else "x y", i % 2) for i in range(150)], "i int, text_a string, text_b string, label int")
    seen = score.arrow_scorer(lambda a, b: [float(len(x) - len(y)) if len(a) <= 64 else None for x, y in zip(a, b, strict=True)])(rows)
    assert {r["logit"] for r in seen.collect()} == {2.0}
    path = str(tmp_path / "model")
    fitted = score.train_scorer(rows, path=path)(rows)
    again = score.load_scorer(path)(rows)
    assert score.validation_f1(fitted) == 1.0 and sorted(r["logit"] for r in fitted.collect()) == sorted(r["logit"] for r in again.collect())


def test_last_line_wins(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": 1, "v": "x"}\n{"k": 2, "v": "y"}\n{"k": 1, "v": "z"}\n')
    assert {tuple(r) for r in jsonl.scan_keyed(spark, str(tmp_path), "k long, v string", ["k"]).collect()} == {(1, "z"), (2, "y")}


def test_curves(spark):
    random.seed(2)
    data = [(i % 3, random.randint(0, 1), round(random.random(), 2)) for i in range(300)]
    df = spark.createDataFrame(data, "topic int, label int, p double")
    for r in diagnose.tau_curve(df, [0.2, 0.5, 0.8], ["topic"]).collect():
        own = [(y, p) for t, y, p in data if t == r["topic"]]
        assert (r["tp"], r["fp"], r["fn"]) == (sum(y for y, p in own if p >= r["tau"]), sum(1 - y for y, p in own if p >= r["tau"]), sum(y for y, p in own if p < r["tau"]))
    assert diagnose.grid(0.1, 0.3, 0.1) == [0.1, 0.2, 0.30000000000000004]
    z = spark.createDataFrame([(2.0, 1), (-2.0, 0), (1.0, 0), (-1.0, 1), (3.0, 1), (0.5, 1)], "logit double, label int")
    got = diagnose.fit_temperature(z)
    loss = lambda t: sum(np.log1p(np.exp(-(2 * y - 1) * x / t)) for x, y in [(2.0, 1), (-2.0, 0), (1.0, 0), (-1.0, 1), (3.0, 1), (0.5, 1)])
    assert loss(got) <= min(loss(got * 1.01), loss(got / 1.01))


def test_alignment(spark):
    p = spark.createDataFrame([(0, ["A", "b", "(", "c", ")", "a", "B"])], "id int, tokens array<string>")
    t = spark.createDataFrame([(0, "a b"), (0, "(c)"), (0, "zz")], "id int, target string")
    assert {(r["target"], r["start"], r["end"]) for r in align.find_spans(p, t, ["id"]).collect()} == {("a b", 0, 2), ("a b", 5, 7), ("(c)", 2, 5)}
    gold = spark.createDataFrame([(0, 0, 0, 2), (0, 1, 1, 3)], "k int, ord int, s long, e long")
    pred = spark.createDataFrame([(0, 0, 1, 3)], "k int, ord int, s long, e long")
    assert tuple(align.greedy_recall(gold, pred, "k").first()) == (0, 1, 2)
    x = spark.createDataFrame([(0, v) for v in (1, 2, 9, 20)], "k int, x long")
    assert {tuple(r) for r in align.merge_intervals(x, ["k"], "x").collect()} == {(0, 0, 3, 2), (0, 8, 10, 1), (0, 19, 21, 1)}


def test_sampling_and_scorers(spark):
    rows = [(t, i, j, int((i + j) % (2 + t) == 0)) for t in range(3) for i in range(6) for j in range(i + 1, 6)] + [(9, 0, j, 0) for j in range(1, 50)]
    df = spark.createDataFrame(rows, "topic int, i int, j int, label int")
    got = {r["topic"]: (r["p"], r["n"]) for r in pairs.training_pairs(df).groupBy("topic").agg(F.sum("label").alias("p"), F.count_if(F.col("label") == 0).alias("n")).collect()}
    for t in range(3):
        pos = sum(r[3] for r in rows if r[0] == t)
        assert got[t] == (pos, min(pos, 15 - pos))
    assert got[9] == (0, 32)
    text = spark.createDataFrame([("a b c", "a b c", 1), ("a b", "x y", 0), ("d e", "d e f", 1), ("q", "z", 0)], "text_a string, text_b string, label int")
    for scorer in (score.lexical_scorer, score.train_scorer(text)):
        out = {r["text_a"]: r["logit"] for r in scorer(text).collect()}
        assert out["a b c"] > out["a b"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"topic_id": 1, "extraction": "[ A | k ] [ B | k ] [ 12 ]"}\n')
    s = ingest.entities(ingest.extractions(spark, str(tmp_path / "in"), "topic_id long, extraction string"))
    q = s.writeStream.format("memory").queryName("ents").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r["norm"], r["type"]) for r in spark.table("ents").orderBy("ord").collect()] == [("a", "k"), ("b", "k")]
