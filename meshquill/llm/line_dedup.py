"""Line dedup by a log-template tree, with DataFrame functions only.

The tree has a fixed depth: a line goes by its token count and its leading tokens to a leaf. Tokens with digits are variable
fields. In a leaf the token that most of its distinct lines have at a place, if at least two and half of them do, is the place's
constant; the other places are variable. A line belongs to the leaf's template if at least ``likeness`` of its tokens are
constants. Each other line of a leaf is compared with the leaf's lines: two are alike if at least ``likeness`` of their tokens
agree, and what is linked by likeness has one template, whatever else is in the leaf. Lines that differ in at most d tokens
agree in one of d + 1 blocks, so only lines that share a block are compared. A template that comes up in two or more documents
recurs: its lines are dropped, but for the first (smallest id), so that what is said many times is said once.

Every line that is not blank counts. Lines of fewer than ``least`` tokens recur only token by token (digits too): they are too
short to tell fields from content. Work on lines is by hashes; tokens are unfolded only
for one line of each distinct form in leaves that hold several. Where the other side is too large for a broadcast, lines are
shuffled once to meet these, and texts once to meet what is to be dropped; groups by template, with partial aggregation, can
be large, and so can the pairs of lines that share a block but are not like their leaf's template.

A null text stays null and has no lines; rows with the same id and text are one document, and so are copies of an id with
another text for the count of documents. All rows with a null id are one document, which comes after all others. Extra columns are kept (names with ``mq_`` are taken).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, let, materialize, small, table
from .components import components

LEAST, LEADING, LIKENESS = 6, 3, 0.8
SPACE = r"\x20\x09-\x0D"


def identity(id_col: str) -> Column:
    """An id that compares and joins as a value where it is null, too, and is largest then."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def raw_lines(docs: DataFrame, id_col: str, text_col: str, least: int) -> DataFrame:
    """mq_id, mq_text (hash), line, mq_line of the lines of at least so many tokens."""
    out = docs.where(F.col(text_col).isNotNull()).select(identity(id_col).alias("mq_id"), F.xxhash64(text_col).alias("mq_text"), F.posexplode(F.split(text_col, "\n", -1)).alias("line", "mq_line"))
    return out.where(F.col("mq_line").rlike(rf"^[{SPACE}]*+(?:[^{SPACE}]++[{SPACE}]++){{{max(least - 1, 0)}}}[^{SPACE}]"))


def tokens_of(line: str) -> Column:
    """The tokens of a line, those with digits masked; most lines have no digit and need no look at each token."""
    words = F.array_remove(F.split(line, rf"[{SPACE}]+", -1), "")
    masked = F.transform(words, lambda t: F.when(t.rlike("[0-9]"), F.lit("<*>")).otherwise(t))
    return F.when(F.col(line).rlike("[0-9]"), masked).otherwise(words)


def lines(docs: DataFrame, id_col: str, text_col: str, leading: int, least: int) -> DataFrame:
    """mq_id, mq_text, line, n (tokens), leaf, form of every line that is not blank; a short line is a leaf of its own."""
    words = F.array_remove(F.split("mq_line", rf"[{SPACE}]+", -1), "")
    out = raw_lines(docs, id_col, text_col, 1).withColumn("words", words).withColumn("n", F.size("words"))
    out = out.withColumn("tokens", F.when(F.col("n") < least, F.col("words")).otherwise(tokens_of("mq_line")))
    form = F.xxhash64("n", "tokens")
    leaf = F.when(F.col("n") < least, form).otherwise(F.xxhash64("n", F.slice("tokens", 1, leading)))
    return out.select("mq_id", "mq_text", "line", "n", leaf.alias("leaf"), form.alias("form"))


def alike(forms: DataFrame, leading: int, likeness: float, scratch: Scratch) -> DataFrame:
    """a, b: the nodes of pairs of forms (leaf, form, n, node, like, tokens) that agree in enough tokens and are not both like the leaf's."""
    room, rest = F.floor(F.col("n") * (1 - likeness) + 1e-9).cast("int"), F.greatest(F.col("n") - leading, F.lit(0))
    at = lambda k: F.floor(k * rest / (room + 1)).cast("int")
    blocks = forms.withColumn("k", F.explode(F.sequence(F.lit(0), room)))
    block = F.slice("tokens", at(F.col("k")) + leading + 1, at(F.col("k") + 1) - at(F.col("k")))
    keys = scratch(blocks.select(F.xxhash64("leaf", "k", block).alias("key"), "form", "like"), "blocks")
    a, b = keys.where("not like").select("key", F.col("form").alias("a")), keys.select("key", F.col("form").alias("b"), "like")
    pairs = a.join(b, "key").where("a < b or (like and a <> b)").select("a", "b").distinct()
    one, other = (forms.select(F.col("form").alias(x), F.col("node").alias(f"{x}_node"), F.col("n").alias(f"{x}_n"), F.col("tokens").alias(f"{x}_tokens")) for x in "ab")
    same = F.size(F.filter(F.zip_with("a_tokens", "b_tokens", lambda x, y: x == y), lambda x: x))
    return pairs.join(one, "a").join(other, "b").where(same >= F.col("a_n") * likeness - 1e-9).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, leading: int = LEADING, likeness: float = LIKENESS) -> DataFrame:
    """mq_id (identity), mq_text, mq_drop: the numbers (from 0) of the lines to drop of each document that has any; written to the shared folder."""
    scratch = Scratch()
    slim = scratch(lines(docs, id_col, text_col, leading, least), "lines")
    first = F.min(F.struct("mq_id", "mq_text", "line")).alias("first")
    forms = slim.groupBy("leaf", "form", "n").agg(first, F.min("mq_id").alias("lo"), F.max("mq_id").alias("hi"))
    forms = scratch(forms, "forms")
    busy = forms.groupBy("leaf").agg(F.count("*").alias("leaf_forms")).where("leaf_forms > 1")
    sample = scratch(forms.join(busy, "leaf").select("leaf", "form", "n", "leaf_forms", "first.*"), "sample")
    chosen = small(sample.select("mq_id", "mq_text", "line", "leaf", "form"))
    met = raw_lines(docs, id_col, text_col, least).join(chosen, ["mq_id", "mq_text", "line"])  # tokens are made for these lines only
    hashed = F.transform(tokens_of("mq_line"), lambda t: F.xxhash64(t))
    tokens = scratch(met.select("leaf", "form", hashed.alias("tokens")).dropDuplicates(["leaf", "form"]), "tokens")
    places = tokens.select("leaf", "form", F.posexplode("tokens").alias("place", "token"))
    told = places.groupBy("leaf", "place", "token").agg(F.count("*").alias("have"))
    most = told.groupBy("leaf", "place").agg(F.max(F.struct("have", "token")).alias("most"))
    constant = most.join(busy, "leaf").where("most.have >= 2 and most.have * 2 >= leaf_forms").select("leaf", "place", F.col("most.token").alias("token"))
    agree = places.join(constant, ["leaf", "place", "token"]).groupBy("leaf", "form").agg(F.count("*").alias("agree"))
    like = forms.join(agree, ["leaf", "form"], "left").withColumn("like", F.coalesce(F.col("agree") >= F.col("n") * likeness, F.lit(False)))
    like = scratch(like.withColumn("node", F.when(F.col("like"), F.col("leaf")).otherwise(F.col("form"))), "like")
    of = components(alike(like.select("leaf", "form", "n", "node", "like").join(tokens, ["leaf", "form"]), leading, likeness, scratch))
    like = like.join(of, "node", "left").withColumn("template", F.coalesce("component", "node"))
    like = scratch(like.select("leaf", "form", "template", "first", "lo", "hi"), "templates")
    templates = like.groupBy("template").agg(F.min("first").alias("kept"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("template", "kept")
    recurring = like.select("leaf", "form", "template").join(templates, "template").select("leaf", "form", "kept")
    out = slim.join(small(scratch(recurring, "recurring")), ["leaf", "form"]).where(F.struct("mq_id", "mq_text", "line") != F.col("kept"))
    out = materialize(out.groupBy("mq_id", "mq_text").agg(F.collect_set("line").alias("mq_drop")), "dropped")
    scratch.release()
    return out


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with mq_dropped (lines dropped) and the text less these lines."""
    gone = dropped_lines(docs, id_col, text_col, **options)
    keyed = docs.withColumns({"mq_hash": F.xxhash64(text_col), "mq_own": identity(id_col)})
    joined = keyed.join(small(gone), (keyed["mq_own"] == gone["mq_id"]) & (keyed["mq_hash"] == gone["mq_text"]), "left")
    parts = F.split(F.col(text_col), "\n", -1)
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("mq_drop"))  # by hash: linear in lines
    kept = let(parts, lambda p: F.transform(left, lambda i: F.get(p, i)))
    text = F.when(F.col("mq_drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return joined.withColumn(text_col, text).withColumn("mq_dropped", F.coalesce(F.size("mq_drop"), F.lit(0))).drop("mq_hash", "mq_own", "mq_id", "mq_text", "mq_drop")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (what is left) of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).alias("n_lines"))
    return without_lines(docs).select("doc_id", F.greatest("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.col("mq_dropped").cast("long").alias("n_dropped"), "text")
