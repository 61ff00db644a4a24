"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Seeds are what fixed patterns find: e-mail addresses, IPv4 addresses, payment cards and phone numbers.
Every word of at least ``SHORTEST`` characters with a digit or an at sign is a candidate (shorter ones, mostly counts, are
neither found nor evidence for or against a pattern), in the context of the one and of the two words
before it: the lexical patterns. A candidate among those words stands there by its form, each run of digits
as ``#`` and an address as ``@``, so that identifiers in a row share patterns. Patterns and candidates form a graph. A pattern's confidence is the
share of what it precedes that is known, each different candidate counting once (and one unknown added, so
that little evidence gives little confidence); known are seeds and candidates of score ``SURE`` or more. A
candidate's score is the chance that not all of its patterns, those that precede ``SUPPORT`` different known
ones, err. What is found in a round counts as known in the next, for support too; what stays unknown speaks
against its patterns in all of them. Rounds go on until none finds anything new, which they must as the
known only grow. Then candidates of score ``SURE`` or more stand found wherever a pattern of that confidence
precedes them: spans of kind ``id`` beside the seeds' own.

The patterns are written so that each character is looked at a bounded number of times and loops don't
nest on Java's stack: possessive where nothing after could use what is given back, and started only
where a leftmost match can start. Texts are read once; graphs and rounds see candidates only.

Defined results: a null text is an empty one, without spans. Repeated rows each get a row; rows without
an id count like others. Texts of any length are read whole; a very common context is summed before it
is joined. Empty tables give no rows. Other columns stay as they are when texts are masked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read, staged, unstage

KINDS = ("email", "ip", "card", "phone")
SURE, SUPPORT, WALK, SHORTEST = 0.8, 3, 128, 4
WORD = 40  # longer words are no context
LOCAL = "A-Za-z0-9._%+-"
PATTERN = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must have for a match: cheap to test.
HINT = {"email": "@", "ip": ".", "phone": "+"}
CANDIDATE = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
SPAN = "array<struct<start:int,end:int>>"
FOUND = "array<struct<start:int,end:int,word:string,one:string,two:string>>"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(d: Column) -> Column:
    """d: 13 to 19 digits."""
    back = F.reverse(d)
    each = F.transform(F.sequence(F.lit(1), F.length(d)), lambda i: F.substr(back, i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    d = _digits(m)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=.)", "").try_cast("int"), F.lit(256)) <= 255)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(9, 15)
    return F.lit(True)


def _let(value: Column, then) -> Column:
    """then(value) with value worked out once, however often then uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def _walk(match: Column, between: Column, row, keep, kind: str) -> Column:
    """An array of what row gives for each match that passes keep; start and end count code points.

    row is given start, end, match and the text before it, which reaches back over two earlier matches.

    Matches go in blocks, so that adding to an array, which copies it, costs a bounded time for each.
    """
    none = F.array().cast(kind)

    def over(v: Column) -> Column:
        n = F.size(v["m"])
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / WALK).cast("int"))

        def inside(b: Column) -> Column:
            return F.sequence(b * WALK + 1, F.least((b + 1) * WALK, n))

        def size(b: Column) -> Column:
            return F.aggregate(inside(b), F.lit(0), lambda a, i: (a + F.length(F.element_at(v["m"], i)) + F.length(F.element_at(v["s"], i))).cast("int"))

        def running(sums: Column) -> Column:
            zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
            return F.aggregate(sums, zero, lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

        def block(starts: Column):
            def one(b: Column) -> Column:
                zero = F.struct(F.element_at(starts, b + 1).alias("at"), none.alias("out"))

                def step(acc: Column, i: Column) -> Column:
                    m, before = F.element_at(v["m"], i), F.element_at(v["s"], i)
                    start = acc["at"] + F.length(before)
                    end = start + F.length(m)
                    gap, last, earlier = (F.coalesce(F.right(F.get(x, i - k), F.lit(WORD + n)), F.lit("")) for x, k, n in ((v["s"], 2, WORD + 4), (v["m"], 2, 2), (v["m"], 3, 2)))
                    out = F.when(keep(m), F.concat(acc["out"], F.array(row(start, end, m, F.concat(earlier, gap, last, before))).cast(kind))).otherwise(acc["out"])
                    return F.struct(end.cast("int").alias("at"), out.alias("out"))

                return F.aggregate(inside(b), zero, step, lambda acc: acc["out"])

            return one

        return _let(running(F.transform(blocks, size)), lambda starts: F.flatten(F.transform(blocks, block(starts))))

    return F.when(F.size(match) > 0, _let(F.struct(match.alias("m"), between.alias("s")), over)).otherwise(none)


def _context(before: Column, words: int) -> Column:
    """The last words of what precedes, in lower case; empty if there are fewer. Words of over 40 characters are no context."""
    near = F.right(before, F.lit(41 * words + 1))
    found = F.lower(F.regexp_replace(F.regexp_extract(near, r"(?:^|\s)" + r"\s++".join([r"(?:\S{1,40}+)"] * words) + r"\s++$", 0), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(found, r"\S*@\S*", "@"), "[0-9]+", "#")


def base_spans(docs: DataFrame, text: str = "text", prefix: str = "_") -> DataFrame:
    """docs with a column of spans for each kind, named by prefix and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    for k in KINDS:
        has = t.contains(HINT[k]) if k in HINT else F.length(t) >= 13
        docs = docs.withColumn(f"{prefix}m", F.when(has, F.regexp_extract_all(t, F.lit(PATTERN[k]), F.lit(0))).otherwise(F.array().cast("array<string>")))
        if k == "card":  # few runs of digits are long enough: split only then
            long = F.exists(f"{prefix}m", lambda m: F.length(m) >= 13)
            docs = docs.withColumn(f"{prefix}m", F.when(long, F.col(f"{prefix}m")).otherwise(F.array().cast("array<string>")))
        docs = docs.withColumn(f"{prefix}s", F.when(F.size(f"{prefix}m") > 0, F.split(t, PATTERN[k], -1)))
        docs = docs.withColumn(f"{prefix}{k}", _walk(F.col(f"{prefix}m"), F.col(f"{prefix}s"), lambda a, b, m, s: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end")), lambda m, k=k: _valid(k, m), SPAN))
    return docs.drop(f"{prefix}m", f"{prefix}s")


def _candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _cand: each word with a digit or an at sign, without marks at its ends, and its contexts."""
    t = F.coalesce(F.col(text), F.lit(""))
    docs = docs.withColumn("_m", F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))
    docs = docs.withColumn("_s", F.when(F.size("_m") > 0, F.split(t, CANDIDATE, -1)))
    lead, tail = r"^[^\p{L}\p{N}+]+", r"[^\p{L}\p{N}]+$"

    def row(a: Column, b: Column, m: Column, s: Column) -> Column:
        inner = F.regexp_replace(m, lead, "")
        word = F.regexp_replace(inner, tail, "")
        start = a + F.length(m) - F.length(inner)
        return F.struct(start.cast("int").alias("start"), (start + F.length(word)).cast("int").alias("end"), word.alias("word"), _context(s, 1).alias("one"), _context(s, 2).alias("two"))

    return docs.withColumn("_cand", _walk(F.col("_m"), F.col("_s"), row, lambda m: F.lit(True), FOUND)).drop("_m", "_s")


def _as_kind(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"))


def _is_kind(kind: str):
    return lambda s: s["kind"] == kind


def extract(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, found): for each row its id, a hash of its text, and arrays of (kind, start, end), base by kind, then start."""
    base = base_spans(docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("key")))
    tagged = F.concat(*[F.transform(f"_{k}", _as_kind(k)) for k in KINDS])
    first = staged(_candidates(base.withColumn("base", tagged)).select("doc_id", "key", "base", F.col("_cand").alias("cand")), "pii")
    # what stands where, copies of a text once
    each = first.where(F.size("cand") > 0).select("key", "base", F.explode("cand").alias("c")).where(F.length("c.word") >= SHORTEST)
    known = F.exists("base", lambda s: (s["start"] < F.col("c.end")) & (s["end"] > F.col("c.start")))
    each = each.select("key", F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.lower("c.word").alias("word"), known.alias("seed"), F.array_distinct(F.array("c.one", "c.two")).alias("p"))
    edge = each.select("word", "seed", F.explode("p").alias("pattern")).where("pattern <> ''").groupBy("pattern", "word").agg(F.max("seed").alias("seed"))
    edge = staged(edge, "pii-graph")  # one row for each different (pattern, word)
    known, many = staged(edge.where("seed").select("word").distinct(), "pii-known"), -1
    while True:
        now = known.count()
        # a pattern's known words, summed before it meets the others
        trust = edge.join(known.withColumn("known", F.lit(1)), "word", "left").groupBy("pattern").agg(F.count("known").alias("support"), (F.count("known") / (F.count("*") + 1)).alias("trust"))
        trust = staged(trust.where(F.col("support") >= SUPPORT).select("pattern", "trust"), "pii-trust")
        if now == many:
            break
        heard = edge.join(trust, "pattern").groupBy("word").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-12)))))).alias("score"))
        new = staged(known.unionAll(heard.where(F.col("score") >= SURE).select("word")).distinct(), "pii-known")
        unstage(known, trust)
        known, many = new, now
    sure = trust.where(F.col("trust") >= SURE).select("pattern")
    hit = each.where(~F.col("seed")).select("key", "start", "end", "word", F.explode("p").alias("pattern")).join(sure, "pattern").join(known, "word")
    found = hit.select("key", F.struct(F.lit("id").alias("kind"), "start", "end").alias("s")).groupBy("key").agg(F.sort_array(F.collect_set("s")).alias("found"))
    out = first.join(found, "key", "left")
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    return out.select("doc_id", "key", "base", F.coalesce("found", empty).alias("found"))


def masked(docs: DataFrame) -> DataFrame:
    """docs with each span's text replaced by its kind, as <EMAIL>; spans that overlap become one. n_chars is counted again."""
    own, key, mark, spans = (fresh(docs, c) for c in ("_id", "_key", "_mark", "_spans"))
    found = extract(docs).select(F.col("doc_id").alias(own), F.col("key").alias(key), F.concat("base", "found").alias(spans)).where(F.size(spans) > 0).dropDuplicates([own, key])
    both = docs.withColumn(mark, F.md5(F.coalesce(F.col("text"), F.lit("")))).join(found, F.col(mark).eqNullSafe(F.col(key)) & F.col("doc_id").eqNullSafe(F.col(own)), "left")
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        gap = F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        out = F.when(s["start"] >= acc["at"], gap).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], end).cast("int").alias("at"), out.alias("out"))

    new = F.aggregate(order, zero, step, lambda a: F.concat(a["out"], F.substr(F.col("text"), a["at"] + 1, F.length("text"))))
    both = both.withColumn("text", F.when(F.col(spans).isNotNull(), new).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col(spans).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return both.select(*[f"`{c}`" for c in docs.columns])


def op4_pii(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of all of documents; see the module for the cases."""
    got = extract(read(spark, sf_dir, "documents"))

    def text(c: Column) -> Column:
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = [F.size(F.filter("base", _is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *count, F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.concat("base", "found")).alias("spans"))
