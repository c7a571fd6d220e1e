"""Personal data: fixed patterns as seeds, and contexts learnt from them by bootstrapping. DataFrame functions only.

Base spans come from one pattern for each kind, leftmost and non-overlapping, and are then checked (parts of
an address, length and Luhn sum of a card, digits of a phone number). A fifth kind of seeds are secrets: runs of at least
16 letters of one case and digits, three or more of each, that overlap no base span. Bootstrapping looks at every whole seed,
and elsewhere at every token with a digit or an at sign and every number written in groups ("mention"), and at the
word before it ("context"). Mentions are told apart by their value, numbers by their digits. Contexts and mentions form a graph. A
context's confidence is the confidence mass of its mentions, each as often as it occurs, over all occurrences of that word
in the corpus, so copies change nothing; a mention takes the confidence of its best context; seeds keep 1. After a few rounds,
confident contexts with enough distinct seeds turn their other mentions into spans of their main kind (of equally frequent kinds
the first one listed).

Null and empty texts have no spans; very long texts are searched whole. Repeated rows get the same spans each; an empty table has
no rows. Other columns, whatever their names, are ignored by `personal_data` and kept as they are by `redact`. Offsets count
code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import id_and_text, materialize, unwrapped, wrapped

KINDS = ("email", "ip", "card", "phone")
#: With the kind whose seeds are no base spans.
ALL = (*KINDS, "secret")

# Possessive forms of the contract's patterns. A match can only start where the character before it does not
# belong to its first run, or right behind the previous match (\G): this keeps the search linear.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": "(?<![A-Za-z0-9])(?:[a-z0-9]{16,}+|[A-Z0-9]{16,}+)(?![A-Za-z0-9])",
}
#: Texts without this have no match.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"\+[0-9]", "secret": "[0-9]"}
# A token for bootstrapping: holds a digit or an at sign, and no blank, quote, bracket, separator or equals sign.
TOKEN = r"[^\s\"'<>()\[\]{},;:|=]"
MENTION = rf"(?<!{TOKEN})(?:(?![0-9@]){TOKEN})*+[0-9@]{TOKEN}*+"
# Groups of digits as numbers are written, with blanks and brackets between; as many groups as a phone has digits.
NUMBER = rf"(?<!{TOKEN})(?:\+|\((?=[0-9]{{1,5}}\)[\x20.-]?[0-9]))?+[0-9]++(?:[\x20().-]{{1,3}}[0-9]++){{0,14}}+(?![./@_%+-]{{0,5}}[\p{{L}}\p{{N}}@])"
CANDIDATE = rf"{NUMBER}|{MENTION}"
#: Characters before a mention in which its context is looked for first; where a word fills them, all text before it is used.
NEAR = 200

SPAN = "array<struct<s:int,e:int,t:string>>"
ROUNDS, CONFIDENT, LEAST_SEEDS = 3, 0.8, 5
#: Matches of a text that are numbered at once; more are numbered in parts, so that work stays in proportion.
TOGETHER = 500
#: Context words of seeds are sent to all tasks up to this size; beyond it they are joined by a shuffle, with the same result.
SEEN_BYTES = 16_000_000


def matches(text: Column, pattern: str) -> Column:
    """All matches as (start, end, text), from the matches and the gaps between them."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # What follows the last match is one gap more, whose match is null.
    pairs = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

    def add(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["g"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("t")))).alias("out"))

    def behind(acc: Column, part: Column) -> Column:
        moved = F.transform(part["out"], lambda x: F.struct((x["s"] + acc["at"]).alias("s"), (x["e"] + acc["at"]).alias("e"), x["t"].alias("t")))
        return F.struct((acc["at"] + part["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    def placed(all_: Column) -> Column:
        first = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))
        last = F.greatest(F.ceil(F.size(all_) / TOGETHER).cast("int") - 1, F.lit(0))
        parts = F.transform(F.sequence(F.lit(0), last), lambda k: F.aggregate(F.slice(all_, k * TOGETHER + 1, F.lit(TOGETHER)), first, add))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.aggregate(parts, start, behind, lambda acc: F.flatten(acc["out"]))

    all_of = F.transform(F.array(pairs), placed)[0]  # so that the matches are found once
    return F.filter(all_of, lambda x: x["t"].isNotNull())


def digits(t: Column) -> Column:
    return F.regexp_replace(t, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    back = F.reverse(number)

    def worth(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + worth(i)) % 10 == 0


VALID = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: F.forall(F.split(t, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")),
    "card": lambda t: F.when(F.length(digits(t)).between(16, 19), luhn(digits(t))).otherwise(False),
    "phone": lambda t: F.length(digits(t)).between(8, 15),
    "secret": lambda t: (F.length(digits(t)) >= 3) & (F.length(t) - F.length(digits(t)) >= 3),
}


def valid(kind: str) -> Column:
    return F.filter(f"_{kind}", lambda x: VALID[kind](x["t"]))


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add one array of valid spans for each kind: columns _email, _ip, _card, _phone, _secret."""
    # Most texts have neither digit nor at sign: one look at them instead of one for each kind.
    t = F.col("_searched")
    docs = docs.withColumn("_searched", F.when(F.col(text).rlike("[0-9@]"), F.col(text)).otherwise(""))
    raw = docs.withColumns({f"_{k}": F.when(t.rlike(NEEDS[k]), matches(t, PATTERNS[k])).otherwise(F.array().cast(SPAN)) for k in ALL})
    sound = raw.drop("_searched").withColumns({f"_{k}": valid(k) for k in ALL})
    base = F.concat(*(F.col(f"_{k}") for k in KINDS))
    return sound.withColumn("_secret", F.filter("_secret", lambda x: ~F.exists(base, lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"]))))


def tagged(kind: str) -> Column:
    """Spans of a kind as (order of the kind, start, end)."""
    return F.transform(f"_{kind}", lambda x: F.struct(F.lit(ALL.index(kind)).alias("k"), x["s"].alias("s"), x["e"].alias("e")))


def base_spans(kinds: tuple[str, ...] = KINDS) -> Column:
    return F.concat(*(tagged(k) for k in kinds))


def joined(spans: Column) -> Column:
    """kind:start:end, by kind and then start, joined by commas."""
    name = F.array(*(F.lit(k) for k in ALL))
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(name, x["k"] + 1), x["s"], x["e"])))


def word_before(text: Column, s: Column) -> Column:
    """The whole word before a place, in lower case; empty where there is none."""

    def last(before: Column) -> Column:
        return F.regexp_extract(F.reverse(before), r"^[\s\"'=:]*+([^\s\"'=:]*+)", 1)

    near = F.substring(text, F.greatest(s - NEAR, F.lit(0)) + 1, F.least(s, F.lit(NEAR)))
    ends = (s <= NEAR) | near.rlike(r"^[^\s\"'=:]*+[\s\"'=:]++[^\s\"'=:]")
    return F.lower(F.reverse(F.when(ends, last(near)).otherwise(last(F.substring(text, F.lit(1), s)))))


def value(t: Column, ip: Column) -> Column:
    """What tells mentions apart: digits (and a leading plus) of a number that is no address, else the text in lower case."""
    return F.when(~ip & t.rlike(r"^[+0-9().\x20-]++$"), F.regexp_replace(t, r"[().\x20-]", "")).otherwise(F.lower(t))


def mentions(docs: DataFrame) -> DataFrame:
    """One row for each mention: key of its row, place, value, context, and its kind where it is a base span.

    A base span inside another one and a token that overlaps a base span are no mentions.
    """
    t = F.col("text")
    own = with_base(docs.where(t.rlike("[0-9@]"))).select("doc_id", "text", base_spans(ALL).alias("base"), matches(t, CANDIDATE).alias("tokens"))

    def inside(x: Column, y: Column) -> Column:
        wider = (y["e"] - y["s"] > x["e"] - x["s"]) | ((y["e"] - y["s"] == x["e"] - x["s"]) & (y["k"] < x["k"]))
        return (y["s"] <= x["s"]) & (y["e"] >= x["e"]) & wider

    outer = F.filter("base", lambda x: ~F.exists("base", lambda y: inside(x, y)))
    free = F.filter("tokens", lambda x: ~F.exists("base", lambda y: (y["s"] < x["e"]) & (y["e"] > x["s"])))
    places = F.concat(
        F.transform(outer, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))),
        F.transform(free, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(None).cast("int").alias("k"))),
    )

    def full(x: Column) -> Column:
        ip = F.coalesce(x["k"] == KINDS.index("ip"), F.lit(False))
        return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("kind"), value(F.substring(t, x["s"] + 1, x["e"] - x["s"]), ip).alias("token"), word_before(t, x["s"]).alias("context"))

    spans = own.select("doc_id", F.xxhash64("text").alias("text_hash"), F.explode(F.transform(places, full)).alias("x"))
    return spans.select("doc_id", "text_hash", "x.s", "x.e", "x.token", "x.context", "x.kind")


def confident_contexts(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(context, kind) of the contexts that bootstrapping trusts, over the whole corpus."""
    edges = materialize(
        found.where(F.length("context") > 1).groupBy("context", "token").agg(F.max("kind").alias("kind"), F.count("*").alias("n")),
        "pii-edges",
    )
    # How often each word occurs at all, whatever follows it.
    seen = materialize(edges.where(F.col("kind").isNotNull()).select("context").distinct(), "pii-seen")
    words = docs.select(F.explode(F.split(F.lower("text"), r"[\s\"'=:]+")).alias("context"))
    size = seen.agg(F.sum(F.octet_length("context") + 64)).first()[0] or 0
    if size <= SEEN_BYTES:  # other words end at the scan
        counted = words.join(F.broadcast(seen), "context", "left_semi").groupBy("context").count()
    else:  # an inner join: a semi join would be pushed below the counting, and all words would be shuffled
        counted = words.groupBy("context").count().join(seen, "context")
    totals = materialize(counted.withColumnRenamed("count", "total"), "pii-words")
    seed = F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0)
    scored = edges.withColumn("trust", seed)
    for _ in range(ROUNDS):
        contexts = (
            scored.groupBy("context")
            .agg(F.sum(F.col("trust") * F.col("n")).alias("mass"), F.sum("n").alias("n"), F.sum(seed).alias("seeds"), F.coalesce(F.mode("kind", True), F.lit(0)).alias("main"))
            .join(totals, "context")
            .withColumn("sure", F.col("mass") / F.greatest("n", "total") * F.least(F.lit(1.0), F.col("seeds") / LEAST_SEEDS))
        )
        tokens = scored.join(contexts.select("context", "sure"), "context").groupBy("token").agg(F.max("sure").alias("best"))
        scored = edges.join(tokens, "token", "left").withColumn("trust", F.greatest(seed, F.coalesce("best", F.lit(0.0)))).drop("best")
        contexts = materialize(contexts, "pii-contexts")
        scored = materialize(scored, "pii-scores")
    good = (F.col("sure") >= CONFIDENT) & (F.col("seeds") >= LEAST_SEEDS)
    return contexts.where(good).select("context", F.col("main").alias("main_kind"))


def discovered(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, extra): spans that confident contexts add, for rows that have any."""
    found = materialize(mentions(docs), "pii-mentions")
    trusted = confident_contexts(found, docs)
    new = found.where(F.col("kind").isNull()).join(trusted, "context")
    return new.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(F.col("main_kind").alias("k"), "s", "e")).alias("extra"))


def with_extra(rows: DataFrame, extra: DataFrame) -> DataFrame:
    """Add `extra` (empty where nothing was discovered) to rows that have doc_id and text_hash; null ids match null ids."""
    other = extra.select(F.col("doc_id").alias("other_id"), F.col("text_hash").alias("other_hash"), "extra")
    same = F.col("doc_id").eqNullSafe(F.col("other_id")) & (F.col("text_hash") == F.col("other_hash"))
    none = F.array().cast("array<struct<k:int,s:int,e:int>>")
    return rows.join(other, same, "left").drop("other_id", "other_hash").withColumn("extra", F.coalesce("extra", none))


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of every row: counts by kind and the digest of the base spans, all spans as text, and how many were added."""
    docs = id_and_text(docs)
    extra = discovered(docs)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in ALL]
    base = with_base(docs).select("doc_id", F.xxhash64("text").alias("text_hash"), *counts, base_spans().alias("base"), tagged("secret").alias("secrets"))
    every = F.concat("base", "secrets", "extra")
    return with_extra(base, extra).select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"),
        "n_secret", F.size("extra").cast("long").alias("n_discovered"), F.size(every).cast("long").alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with every span replaced by its kind in brackets; overlapping spans are replaced once. n_chars follows."""
    extra = discovered(id_and_text(docs))
    rows = with_base(wrapped(docs)).select("doc_id", "text", "row", F.xxhash64("text").alias("text_hash"), base_spans(ALL).alias("base"))
    rows = with_extra(rows, extra)
    by_start = F.array_sort(F.transform(F.concat("base", "extra"), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    tag = F.array(*(F.lit(f"[{k.upper()}]") for k in ALL))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def put(acc: Column, x: Column) -> Column:
        kept = F.substring(F.col("text"), acc["at"] + 1, F.greatest(x["s"] - acc["at"], F.lit(0)))
        more = F.when(x["s"] >= acc["at"], F.concat(acc["out"], kept, F.element_at(tag, x["k"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), more.alias("out"))

    done = F.aggregate(by_start, start, put, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))))
    rows = rows.withColumn("text", F.when(F.size("base") + F.size("extra") > 0, done).otherwise(F.col("text")))
    return unwrapped(rows, docs.columns, text=F.col("text"), n_chars=F.length("text").cast("long"))
