from clusterloom.operators import minspan


def test_heads():
    # (NP (NP the big dog) (PP of (NP my friends)))
    words, pos = ["the", "big", "dog", "of", "my", "friends"], ["DT", "JJ", "NN", "IN", "PRP$", "NNS"]
    parse = ["(NP(NP*", "*", "*)", "(PP*", "(NP*", "*)))"]
    assert minspan.min_span(words, pos, parse) == ("NP", ["0:the", "1:big", "2:dog"])
    assert minspan.min_span(["dogs"], ["NNS"], ["(NP*)"]) == ("NP", ["0:dogs"])
    assert minspan.min_span(["to", "run"], ["TO", "VB"], ["(VP*", "*)"]) == ("VP", ["0:to", "1:run"])


def test_conjunction_takes_both_phrases():
    words, pos = ["cats", "and", "dogs"], ["NNS", "CC", "NNS"]
    assert minspan.min_span(words, pos, ["(NP(NP*)", "*", "(NP*))"]) == ("NP", ["0:cats", "2:dogs"])


def test_odd_trees():
    assert minspan.min_span(["a", "b"], ["X", "X"], ["*", "*"]) == ("", ["0:a", "1:b"])
    assert minspan.min_span(["a", "b"], ["X", "X"], ["(NP*", "*"]) == ("NP", ["0:a", "1:b"])
    assert minspan.min_span([",", "("], [",", "-LRB-"], ["(NP*", "*)"])[1] == ["0:,", "1:("]
    assert minspan.min_span(["a"], ["X"], ["-"]) == (None, ["0:a"])
    # no phrase at the top two levels: the tree below decides
    assert minspan.min_span(["one", "of", "us"], ["CD", "IN", "PRP"], ["(TOP(S(NP(NP*)", "(PP*", "(NP*)))))"])[1] == ["0:one"]


def test_pruning(spark):
    rows = [("d", 1, "NP"), ("d", 1, "VP"), ("d", 1, "NP"), ("d", 2, "VP"), ("d", 2, "NP"), ("d", 3, "NP"), ("d", 4, None)]
    df = spark.createDataFrame(rows, "doc string, cluster int, tag string")
    assert sorted(r["cluster"] for r in minspan.noun_phrases_only(df).collect()) == [1, 1, 3, 4]
    assert sorted(r["cluster"] for r in minspan.noun_phrases_only(df, partial=False).collect()) == [3, 4]


def test_spark_identity(spark):
    df = spark.createDataFrame([(["big", "dog"], ["JJ", "NN"], ["(NP*", "*)"])], "w array<string>, p array<string>, t array<string>")
    r = df.select(minspan.span_of("w", "p", "t").alias("m")).first()["m"]
    assert (r["tag"], r["span"]) == ("NP", ["0:big", "1:dog"])
