"""CoNLL coreference annotation: encoding spans into cells and reading them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def encode(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """doc, pos, cell for each token: single-token clusters, else starts (by end, descending), else ends (by start, descending), else -.

    tokens: doc, pos; mentions: doc, start, end (inclusive), cluster.
    """
    show = lambda a, pre, post: F.array_join(F.transform(a, lambda x: F.concat(F.lit(pre), x["c"].cast("string"), F.lit(post))), "|")
    down = lambda c, o: F.sort_array(F.collect_list(F.struct(F.col(o).alias("o"), F.col("cluster").alias("c"))), asc=False)
    one = mentions.where("start = end").groupBy("doc", F.col("start").alias("pos")).agg(show(F.array_sort(F.collect_list(F.struct(F.col("cluster").alias("c")))), "(", ")").alias("single"))
    a = mentions.where("start < end").groupBy("doc", F.col("start").alias("pos")).agg(show(down("cluster", "end"), "(", "").alias("opens"))
    b = mentions.where("start < end").groupBy("doc", F.col("end").alias("pos")).agg(show(down("cluster", "start"), "", ")").alias("closes"))
    out = tokens.select("doc", "pos").join(one, ["doc", "pos"], "left").join(a, ["doc", "pos"], "left").join(b, ["doc", "pos"], "left")
    return out.select("doc", "pos", F.coalesce("single", "opens", "closes", F.lit("-")).alias("cell"))


def write(cells: DataFrame, path: str) -> None:
    """One line a token between #begin and #end lines of each document: pos, doc_id, token_id, word, cell by tabs.

    cells: doc, pos, word, cell, and doc_id and token_id within the document's paragraphs (else doc and pos).  Lines are rows
    of a range-partitioned sort, so no document has to fit one row and each stays in one file.
    """
    own = lambda c, rest: F.col(c if c in cells.columns else rest).cast("string")
    line = F.concat_ws("\t", F.col("pos").cast("string"), own("doc_id", "doc"), own("token_id", "pos"), "word", "cell")
    lines = cells.select("doc", F.col("pos").cast("long").alias("at"), line.alias("value"))
    docs = cells.select("doc").distinct()
    first = docs.select("doc", F.lit(-1).cast("long").alias("at"), F.concat(F.lit("#begin document "), F.col("doc").cast("string")).alias("value"))
    last = docs.select("doc", F.lit((1 << 63) - 1).alias("at"), F.lit("#end document").alias("value"))
    lines.unionByName(first).unionByName(last).repartitionByRange("doc").sortWithinPartitions("doc", "at").select("value").write.mode("overwrite").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc, sent, pos, cell, columns: the white-space columns of each token line and the last of them; blank lines part sentences, repeated ones count once.

    A name that begins again appends to its document.  Files are read in splits; lines are ordered by file, split and place.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id().alias("k")).alias("n"), F.col("value").alias("line"))
    by = W.partitionBy("file").orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    begin = F.col("line").startswith("#begin document")
    marked = lines.withColumns({"doc": F.last(F.when(begin, F.regexp_extract("line", r"#begin document (.*)$", 1)), ignorenulls=True).over(by), "blank": F.trim(F.regexp_replace("line", r"\s+", " ")) == ""})
    rows = marked.where(~F.col("line").startswith("#"))
    rows = rows.withColumn("step", (F.col("blank") & ~F.coalesce(F.lag("blank").over(W.partitionBy("doc").orderBy("file", "n")), F.lit(True))).cast("int"))
    inner = W.partitionBy("doc").orderBy("file", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("sent", F.sum("step").over(inner)).where("not blank and doc is not null")
    parts = F.split(F.regexp_replace("line", r"^\s+|\s+$", ""), r"\s+")
    return rows.select("doc", "sent", (F.row_number().over(W.partitionBy("doc").orderBy("file", "n")) - 1).alias("pos"), F.element_at(parts, -1).alias("cell"), parts.alias("columns"))


#: Fixed value: the place of the constituency column in annotation of over PARSE_COLUMN + 1 columns.
PARSE_COLUMN = 5


def has_parse(tokens: DataFrame) -> DataFrame:
    """doc, has_parse: whether a document's first line with a parse column has a tree there and not -.  tokens as `read` gives them."""
    wide = tokens.where(F.size("columns") > PARSE_COLUMN + 1).groupBy("doc").agg(F.min_by(F.get("columns", F.lit(PARSE_COLUMN)), "pos").alias("tree"))
    return tokens.select("doc").distinct().join(wide, "doc", "left").select("doc", F.coalesce(F.col("tree") != "-", F.lit(False)).alias("has_parse"))


def cell_marks(cell: Column) -> Column:
    """array<struct<cluster, opens, closes>> of a cell, in its order.

    ( opens, ) closes and | ends a mark; characters besides them and digits mean nothing.  A ( before another one, an empty pair
    and a number with neither bracket give no mark.
    """
    plain = F.regexp_replace(cell, r"[^0-9()|]", "")
    part = lambda i: F.regexp_extract_all(plain, F.lit(r"(\(?)([0-9]+)(\)|\||$)"), F.lit(i))
    ends = F.zip_with(part(1), part(3), lambda a, z: F.struct((a == "(").alias("opens"), (z == ")").alias("closes")))
    marks = F.zip_with(part(2), ends, lambda c, e: F.struct(c.cast("long").alias("cluster"), e["opens"].alias("opens"), e["closes"].alias("closes")))
    return F.filter(marks, lambda m: m["opens"] | m["closes"])


def decode(cells: DataFrame) -> DataFrame:
    """doc, start, end (inclusive), cluster of well-nested cells, last opened first closed.

    Within a document and cluster an open mark at depth d is met by the next close mark at depth d; unmet marks give no mention
    and leave the depth of the others as it is.
    """
    marks = cells.select("doc", "pos", F.posexplode(cell_marks(F.col("cell"))).alias("k", "m")).select("doc", "pos", "k", "m.*")
    single = marks.where("opens and closes").select("doc", F.col("pos").alias("start"), F.col("pos").alias("end"), "cluster")
    edges = marks.where("opens <> closes").withColumn("step", F.when(F.col("opens"), 1).otherwise(-1))
    run = W.partitionBy("doc", "cluster").orderBy("pos", F.desc("step"), "k").rowsBetween(W.unboundedPreceding, 0)
    edges = edges.withColumn("level", F.sum("step").over(run)).withColumn("floor", F.least(F.coalesce(F.min("level").over(run.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)), F.lit(0)))
    edges = edges.where("level >= floor").withColumn("depth", F.col("level") - F.col("floor") + F.when(F.col("opens"), 0).otherwise(1))
    edges = edges.withColumn("n", F.row_number().over(W.partitionBy("doc", "cluster", "depth", "opens").orderBy("pos", "k")))
    a = edges.where("opens").select("doc", "cluster", "depth", "n", F.col("pos").alias("start"))
    b = edges.where("closes").select("doc", "cluster", "depth", "n", F.col("pos").alias("end"))
    return a.join(b, ["doc", "cluster", "depth", "n"]).select("doc", "start", "end", "cluster").unionByName(single)
