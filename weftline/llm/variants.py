"""Grouping spelling variants: words within one edit of each other, by an even-partition pigeonhole join.

A word of l letters is cut into two even segments. One edit leaves one of them as it is, so two words are near only if they share a
segment at its place, or, where one word is a letter longer, shifted by one behind the edit. Every word is indexed by its
two segments under its length, and probes the index with its own segments (equal lengths) and with the substrings of
itself that a word one letter shorter would have there.

A segment says where the edit may lie: in the stretch [low, high) that it leaves out. Keys that many words share (common
endings, say) are not joined: each stretch of such a key is halved again, and the half without the edit joins the key. So
keys grow until few words share them or the stretch is one letter, where at most an alphabet of words can meet; no pairs of a
large group are made, and none is lost. Candidates of a key are verified by their edit distance within the join and repeats
of a pair dropped.

Null texts have no runs, null ids count as the empty text. Repeated rows count as often as they stand there. Very
long texts are taken whole. Ties for a form go to the word that is smallest in code-point order. An empty table gives no words.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import discard, materialize, quoted

LETTERS = "A-Za-zÀ-ÿ"
SHORTEST, LEAST, TIMES, DROP = 7, 2, 10, 31
#: Pairs that a key may make before its stretch is halved.
PAIRS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pairs of the statement are words that are equal without one letter, at the same place or in one of them only; crc32 is its table-free definition.
ORACLE = r"""
WITH RECURSIVE run AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents),
steps AS (SELECT list(r ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM (SELECT unnest(range(256)) AS i))),
hashed AS (SELECT run, xor(list_reduce([4294967295] || list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda k: CAST(('0x' || x[2 * k + 1:2 * k + 2]) AS BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM (SELECT run, hex(encode(doc_id || ':' || run)) AS x FROM run), steps),
words AS (SELECT word, count(*) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed) WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word UNION SELECT DISTINCT w.word, w.n, l.word, l.n FROM words w JOIN less l ON w.word = l.rest),
sides AS (SELECT a AS word, b AS other, n_b AS m FROM pairs UNION ALL SELECT b, a, n_a FROM pairs),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM sides GROUP BY word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * w.n THEN other END AS form, CASE WHEN m >= 10 * w.n THEN m END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
way AS (SELECT word, word AS here, form AS next FROM forms UNION ALL SELECT y.word, y.next, f.form FROM way y JOIN forms f ON f.word = y.next)
SELECT f.word, n, n_near, form, form_n, here AS root FROM forms f JOIN way y ON f.word = y.word AND y.next IS NULL
"""


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, least: int = LEAST, drop: int | None = DROP) -> DataFrame:
    """(word, n): runs of letters with ASCII lower-cased, of which one in `drop`, by hash of document and run, loses a letter."""
    key = F.coalesce(quoted(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("id"), F.explode(F.regexp_extract_all(quoted(text_col).cast("string"), F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("run"))
    run = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run"))
    runs = runs.select("id", run.alias("run"))
    word = F.col("run")
    if drop:
        h = F.crc32(F.concat_ws(":", "id", "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % drop == 0, F.concat(F.substring(F.col("run"), F.lit(1), at), F.substr("run", at + 2))).otherwise(word)
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def without(word: str, low: str, high):
    """The word without the letters from `low` to `high`."""
    return F.concat(F.substring(F.col(word), F.lit(1), F.col(low)), F.lit("\0"), F.substr(word, high + 1))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (word, n, long, low, high) with the key of what the stretch leaves; `long` rows stand for words one letter shorter."""
    length = F.length("word") - F.col("long").cast("int")
    rest = without("word", "low", F.col("high") + F.col("long").cast("int"))
    return rows.select("word", "n", "long", "low", "high", F.xxhash64(length, "low", "high", rest).alias("key"))


def halved(rows: DataFrame) -> DataFrame:
    """Rows by the two halves of their stretch."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    return keyed(rows.select("word", "n", "long", F.explode(halves).alias("s")).select("word", "n", "long", "s.low", "s.high"))


def near_words(words: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """(a, n_a, b, n_b): every pair of distinct words (word, n) with exactly one inserted, deleted or replaced letter between them, once."""
    shorter = words.withColumn("long", F.explode(F.array(F.lit(False), F.lit(True))))
    length = F.length("word") - F.col("long").cast("int")
    rows = halved(shorter.select("word", "n", "long", F.lit(0).alias("low"), length.alias("high")).where("high > 0"))
    found, level = [], None
    while True:
        rows = materialize(rows, "segments")
        if level is not None:
            discard(level)
        level = rows
        sizes = rows.groupBy("key").agg(F.sum((~F.col("long")).cast("long")).alias("own"), F.count("*").alias("all"), F.max(F.col("high") - F.col("low")).alias("stretch"))
        # A key of one word alone, or of long ones only, has no pair.
        open_ = materialize(sizes.where("own > 0 AND all > 1").select("key", ((F.col("own") * F.col("all") > pairs) & (F.col("stretch") > 1)).alias("split")), "keys")
        few = rows.join(open_.where("not split").select("key"), "key", "left_semi")
        index = few.where("not long").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
        probe = few.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "long")
        near = index.join(probe, "key").where((F.col("long") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
        found.append(materialize(near.select("a", "n_a", "b", "n_b"), "near-words"))
        many = open_.where("split").select("key")
        if many.isEmpty():
            discard(open_)
            break
        rows = halved(rows.join(many, "key", "left_semi"))
    discard(level)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = materialize(out.distinct(), "near-words")
    discard(*found)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms (word, form) that follow each other from each word; each round doubles the way."""
    now = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("at"), F.col("root").alias("further"))
        fresh = materialize(now.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(now)
        now = fresh.select("word", "root")
        now.written_to = fresh.written_to
        if fresh.where("moved").isEmpty():
            return now


def grouped(words: DataFrame, times: int = TIMES, pairs: int = PAIRS) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of distinct words (word, n)."""
    words = materialize(words, "words")
    near = near_words(words, pairs)
    sides = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    known = materialize(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    discard(words, near)
    last = roots(known.where(F.col("form").isNotNull()).select("word", "form"))
    return known.join(last, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def spelling_variants(docs: DataFrame, **columns: str) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of whole texts: near words, the usual form of each and where forms end."""
    return grouped(counted(docs, **columns))
