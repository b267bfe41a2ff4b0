"""Personal data by bootstrapped contextual extraction, in Spark functions only.

Four kinds with a fixed form (e-mail, IP address, card and phone numbers) are found first. They and other
tokens with a digit, of any length, are instances: token characters, joined by single `-`, `.`, `/` or, between
digits, spaces. The two lexemes (letters, digits or one sign) before an instance are a pattern, however far
before it they stand. Seeds are the four kinds and tokens of a secret's form. Patterns and instances make a graph that is
scored in rounds: a pattern's confidence is the score of its instances over all its occurrences in the
corpus, whatever follows it; an instance's score is the chance that one of its patterns is right. Instances
in patterns of high confidence that no base span covers are new spans, of kind `context`.

Patterns need at least `MIN_SUPPORT` instances, at any size of the corpus. Occurrences are counted only of those
whose instances alone don't rule out that they are confident. Joins are by shuffle, but keys with a
share `SHARE` of the rows, of which there are few at any size, are joined by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, without

KINDS = ("email", "ip", "card", "phone", "context")
MIN_SUPPORT, SHARE = 5, 5e-4
ROUNDS, CONFIDENT = 3, 0.5
#: Code points before an instance in which its pattern's lexemes are sought first; if they may begin before
#: them, the next number counts, and at last the whole text before the instance.
NEAR = (48, 1024, 16384)
#: Words of 64 bits of the bitmap of patterns.
BITMAP_WORDS = 1 << 14
#: Stands for a dot or a separator between two characters of a match; in texts it is mapped to OTHER first.
MARK, OTHER = "\ue000", "\ue001"
#: Tokens of this form are seeds, too.
SECRET = r"^(?=.*[0-9])(?=.*[A-Za-z])(?:[0-9a-f]{32,}|AKIA[0-9A-Z]{16})$"
_LEXEME = r"\p{L}+|[0-9]+|[^\p{L}0-9\x20\x09-\x0D]"
_SPAN = "struct<kind:string,start:long,end:long>"


def _positions(text: Column, pattern: str) -> Column:
    """An array of (start, end, value) of the pattern's leftmost matches that don't overlap."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    sizes = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda b, m: F.struct(b.alias("before"), m.alias("value")))
    return F.when(F.size(found) > 0, running(sizes)).otherwise(F.array().cast("array<struct<start:long,end:long,value:string>>"))


def running(sizes: Column, block: int = 64) -> Column:
    """(start, end, value) of rows (before, value): sums along blocks of rows, then along the blocks."""
    kind = "array<struct<start:long,end:long,value:string>>"

    def add(acc, x):
        start = acc["at"] + x["before"]
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["rows"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("rows"))

    def part(i):
        return F.aggregate(F.slice(sizes, i * block + 1, block), F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("rows")), add)

    parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), part)

    def shift(acc, p):
        moved = F.transform(p["rows"], lambda r: F.struct((r["start"] + acc["at"]).alias("start"), (r["end"] + acc["at"]).alias("end"), r["value"].alias("value")))
        return F.struct((acc["at"] + p["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
    return F.aggregate(parts, first, shift, lambda acc: F.flatten(acc["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def _luhn(value: Column) -> Column:
    d = F.reverse(_digits(value))
    each = F.transform(F.sequence(F.lit(0), F.length(d) - 1), lambda i: F.substr(d, i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


def base_spans(text: Column) -> dict[str, Column]:
    """By kind, an array of (start, end, value); the text is not null.

    Repeated groups would recurse in the pattern engine, so a dot or separator between two characters of the
    right kind is mapped to MARK first, and repetition is over single characters only. Each pattern starts
    where a leftmost match can start.
    """
    plain = F.replace(text, F.lit(MARK), F.lit(OTHER))
    dotted = F.regexp_replace(plain, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", MARK)
    local = rf"A-Za-z0-9._%+\-{MARK}"
    email = rf"(?:\G|(?<![{local}]))[{local}]++@[A-Za-z0-9-]++{MARK}[A-Za-z0-9{MARK}-]++"
    joined = F.regexp_replace(plain, r"(?<=[0-9])[\x20-](?=[0-9])", MARK)
    card = rf"(?<![0-9{MARK}])[0-9][0-9{MARK}]++"
    ip = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    none = F.array().cast("array<struct<start:long,end:long,value:string>>")
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(F.concat(F.lit("000"), F.ltrim(p, F.lit("0"))), F.lit(3)).cast("int") <= 255)
    parts = lambda v: F.forall(F.split(v, r"\."), small)
    count = lambda v: F.length(_digits(v))
    # a cheap look for what every match holds comes before each search
    has = lambda p: F.regexp_like(text, F.lit(p))
    return {
        "email": F.when(F.contains(text, F.lit("@")), _positions(dotted, email)).otherwise(none),
        "ip": F.when(has(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), F.filter(_positions(plain, ip), lambda m: parts(m["value"]))).otherwise(none),
        "card": F.when(has(r"(?:[0-9][\x20-]?){12}[0-9]"), F.filter(_positions(joined, card), lambda m: F.when(count(m["value"]).between(13, 19), _luhn(m["value"])).otherwise(False))).otherwise(none),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(_positions(plain, phone), lambda m: count(m["value"]).between(9, 15))).otherwise(none),
    }


def _lexemes(text: Column) -> Column:
    """Lexemes in lower case; each run of digits is a 9."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]+", "9"), F.lit(_LEXEME), F.lit(0))


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _pattern(text: Column, start: Column) -> Column:
    """The two lexemes before start (0-based); null if there are fewer."""

    def last(got: Column) -> Column:
        return F.when(F.size(got) >= 2, F.concat_ws(" ", F.get(got, F.size(got) - 2), F.get(got, F.size(got) - 1)))

    def within(n: int, farther: Column) -> Column:
        near = _lexemes(F.substr(text, F.greatest(start - n + 1, F.lit(1)).cast("int"), F.least(start, F.lit(n)).cast("int")))
        # the first lexeme may be cut, so three of them tell the last two
        return _let(near, lambda got: F.when((start <= n) | (F.size(got) >= 3), last(got)).otherwise(farther))

    out = _let(_lexemes(F.substr(text, F.lit(1), start.cast("int"))), last)
    for n in reversed(NEAR):
        out = within(n, out)
    return out


#: Tokens with a digit, in texts whose joining signs are MARKs.
_TOKEN = rf"(?<![A-Za-z0-9_{MARK}])(?=[A-Za-z_{MARK}]*+[0-9])[A-Za-z0-9_{MARK}]++"
_JOINT = r"(?<=[A-Za-z0-9_])[./-](?=[A-Za-z0-9_])|(?<=[0-9])\x20(?=[0-9])"


def _instances(text: Column) -> Column:
    """Tokens with a digit and their pattern: (start, end, value, pattern)."""
    rows = _positions(F.regexp_replace(F.replace(text, F.lit(MARK), F.lit(OTHER)), _JOINT, MARK), _TOKEN)
    return F.transform(rows, lambda r: F.struct(r["start"], r["end"], r["value"], _pattern(text, r["start"]).alias("pattern")))


def scan(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry, key (the text's digest), base (array of kind, start, end) and found (instances outside base)."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*carry, t.alias("__t"))
    spans = base_spans(F.col("__t"))
    rows = rows.select(*carry, "__t", *[spans[k].alias(k) for k in KINDS[:4]])

    def named(kind: str) -> Column:
        return F.transform(kind, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    base = F.concat(*[named(k) for k in KINDS[:4]])
    some = F.regexp_like("__t", F.lit("[0-9]"))
    rows = rows.select(*carry, F.sha2(F.col("__t").cast("binary"), 256).alias("key"), base.cast(f"array<{_SPAN}>").alias("base"), "__t", *KINDS[:4])
    seeds = F.concat(*[F.transform(k, lambda m: F.struct(m["start"], m["end"], F.translate(m["value"], MARK, ".").alias("value"), _pattern(F.col("__t"), m["start"]).alias("pattern"), F.lit(True).alias("seed"))) for k in KINDS[:4]])
    # without its base spans a text's tokens are those that no base span touches
    tokens = F.filter(_instances(F.col("__t")), lambda r: ~F.exists("base", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"])))
    tokens = F.transform(tokens, lambda r: F.struct(r["start"], r["end"], r["value"], r["pattern"], F.regexp_like(r["value"], F.lit(SECRET)).alias("seed")))
    kind = "array<struct<start:long,end:long,value:string,pattern:string,seed:boolean>>"
    return rows.select(*carry, "key", "base", F.concat(F.when(F.size("base") > 0, seeds.cast(kind)).otherwise(F.array().cast(kind)), F.when(some, tokens.cast(kind)).otherwise(F.array().cast(kind))).alias("found"))


def occurrences(docs: DataFrame, patterns: DataFrame, *, text: str = "text") -> DataFrame:
    """(pattern, total): how often each pattern's two lexemes stand side by side in the texts."""
    rows = docs.select(_lexemes(F.coalesce(F.col(text), F.lit(""))).alias("__l")).filter(F.size("__l") >= 2)
    pairs = F.zip_with(F.slice("__l", 1, F.size("__l") - 1), F.slice("__l", 2, F.size("__l")), lambda a, b: F.concat(a, F.lit(" "), b))
    every = rows.select(F.explode(pairs).alias("pattern"))
    # a bitmap of fixed size keeps most other pairs out of the count; the join after it is exact
    at = F.pmod(F.xxhash64("pattern"), F.lit(64 * BITMAP_WORDS))
    word, bit = F.floor(at / 64), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))
    got = dict(patterns.groupBy(word.alias("w")).agg(F.bit_or(bit)).collect())  # at most BITMAP_WORDS rows
    bitmap = F.split(F.lit(",".join(str(got.get(i, 0)) for i in range(BITMAP_WORDS))), ",").cast("array<bigint>")
    maybe = every.filter(F.get(bitmap, word.cast("int")).bitwiseAND(bit) != 0)
    totals = maybe.groupBy("pattern").agg(F.count("*").alias("total"))
    # an inner join, as a semi join would be moved below the count
    return totals.join(patterns.select("pattern").distinct(), "pattern")


def hot(graph: DataFrame, key: str) -> DataFrame:
    """The keys with at least SHARE of the graph's rows or of their occurrences n: at most 2 / SHARE."""
    rows, n = graph.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sizes = graph.groupBy(key).agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    return materialize(sizes.filter((F.col("m") >= SHARE * rows) | (F.col("n") >= SHARE * n)).select(key), f"pii-hot-{key}")


def _met(rows: DataFrame, table: DataFrame, key: str, often: DataFrame) -> DataFrame:
    """rows joined with table, one row a key: keys in often by broadcast, the others by shuffle."""
    often = F.broadcast(often)  # at most 2 / SHARE rows
    few = rows.join(F.broadcast(table.join(often, key, "left_semi")), key)
    return few.unionByName(rows.join(often, key, "left_anti").join(table.join(often, key, "left_anti"), key))


def promising(graph: DataFrame, hot_patterns: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(pattern): those that bootstrap() may find confident; the others can't be, whatever their totals.

    A pattern occurs at least as often as it has instances, and no score is over 1. So the share of its
    instances that are seeds, or in a pattern that may be confident, bounds its confidence in each round.
    """
    value = graph.groupBy("value").agg(F.max(F.col("seed").cast("int")).alias("known"))
    edges, hot_values, found = graph.select("pattern", "value", "n"), hot(graph, "value"), None
    for _ in range(rounds):
        value = materialize(value, "pii-known")
        bound = _met(edges, value, "value", hot_values).groupBy("pattern").agg((F.sum(F.col("n") * F.col("known")) / F.sum("n")).alias("bound"))
        found = materialize(bound.filter(F.col("bound") >= CONFIDENT).select("pattern"), "pii-promising")
        reached = _met(edges, found, "pattern", hot_patterns).select("value").distinct().withColumn("reached", F.lit(1))
        value = value.join(reached, "value", "left").select("value", F.greatest("known", F.coalesce("reached", F.lit(0))).alias("known"))
    return found


def bootstrap(graph: DataFrame, totals: DataFrame, hot_patterns: DataFrame, seeds: DataFrame, *, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, confidence) of a graph (pattern, value, n) and totals (pattern, total); seeds: (value, seed), a row or more each."""
    score = seeds.groupBy("value").agg(F.max(F.col("seed").cast("double")).alias("score"), F.max("seed").alias("seed"))
    edges, confidence, hot_values = graph.select("pattern", "value", "n"), None, hot(graph, "value")
    for _ in range(rounds):
        score = materialize(score, "pii-score")
        met = _met(edges, score, "value", hot_values).groupBy("pattern").agg(F.sum(F.col("n") * F.col("score")).alias("hits"))
        confidence = materialize(met.join(totals, "pattern").select("pattern", F.least(F.lit(1.0), F.col("hits") / F.greatest("total", F.lit(1))).alias("confidence")), "pii-confidence")
        wrong = F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))
        reached = _met(edges, confidence.filter(F.col("confidence") >= CONFIDENT), "pattern", hot_patterns).groupBy("value").agg((1 - wrong).alias("reached"))
        score = score.join(reached, "value", "left").select("value", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("reached", F.lit(0.0))).alias("score"), "seed")
    return confidence


def find(docs: DataFrame, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in carry with spans: (kind, start, end) by kind in the order of KINDS, then start; code points, end exclusive.

    Base matches that fail their check are dropped without another try. A null text is empty; a text without
    matches has no spans. Equal texts get equal spans, so repeated rows agree. Spans of kind context never
    overlap base ones of the same text.
    """
    scanned = materialize(scan(docs, text=text, carry=carry), "pii-scan")
    rows = scanned.filter(F.size("found") > 0).select("key", F.explode("found").alias("f")).select("key", "f.*").filter(F.col("pattern").isNotNull())
    graph = materialize(rows.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n")), "pii-graph")
    support = materialize(graph.groupBy("pattern").agg(F.count("*").alias("m")).filter(F.col("m") >= MIN_SUPPORT).select("pattern"), "pii-patterns")
    often = hot(graph, "pattern")
    supported = materialize(_met(graph, support, "pattern", often), "pii-supported")
    chosen = promising(supported, often)
    kept = materialize(_met(supported, chosen, "pattern", often), "pii-kept")
    totals = materialize(occurrences(docs, chosen, text=text), "pii-totals")
    sure = materialize(bootstrap(kept, totals, often, supported.select("value", "seed")).filter(F.col("confidence") >= CONFIDENT).select("pattern"), "pii-sure")
    covered = _met(rows.filter(~F.col("seed") | F.col("value").rlike(SECRET)), sure, "pattern", often)
    new = covered.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.lit("context").alias("kind"), "start", "end"))).alias("more"))
    spans = scanned.select(*carry, "key", "base").join(new, "key", "left")
    return spans.select(*carry, "key", F.concat("base", F.coalesce(F.col("more").cast(f"array<{_SPAN}>"), F.array().cast(f"array<{_SPAN}>"))).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; where spans overlap, the one that starts first (then the longer, then by kind) stands for all.

    Null texts stay null.
    """
    named = without(docs, ["__key", "__spans"])
    found = find(named.filter(F.col(text).isNotNull()), text=text, carry=()).filter(F.size("spans") > 0).dropDuplicates(["key"]).select(F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    keyed = named.withColumn("__key", F.sha2(F.col(text).cast("binary"), 256)).join(found, "__key", "left")
    order = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"], (-s["end"]).alias("back"), s["kind"])))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts"))
    t = F.col(text)

    def step(acc, s):
        piece = F.substr(t, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        new = F.struct((-s["back"]).alias("at"), F.concat(acc["parts"], F.array(piece, F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">")))).alias("parts"))
        longer = F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["parts"].alias("parts"))
        return F.when(s["start"] >= acc["at"], new).otherwise(longer)

    clean = F.aggregate(order, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(t, (acc["at"] + 1).cast("int"), F.length(t))))
    return keyed.withColumn(text, F.when(F.col("__spans").isNull(), t).otherwise(clean)).select(*docs.columns)
