"""Secret scan: fixed patterns, and strings that a Markov model of random characters explains better than one of identifiers.

Both models are first-order character chains. The random one is learned from seeded digests written in hex, base 64 and
mixed case; the ordinary one from WORDS and words of the scanned table itself, also capitalised, in capitals and joined
into identifiers. Both samples are labelled by how they were made. A candidate (a long run of key characters with a digit and a letter) is reported
where the log-likelihood ratio of the two chains, less DRIFT for each pair of neighbours, is high in total over its best stretch, so that
an ordinary path before a key does not hide it.

Only DataFrame functions run. Nothing is shuffled but the bigram counts, at most |ALPHABET|² rows for each label, which the
driver reads to put the table of ratios into the plan. Work on a text grows with its length: spans come from folds over runs of FOLD matches, and what
candidates may not touch is blanked in the text instead of being compared with each of them.

Cases: a null text is empty and has no spans; overlapping matches of different kinds are all reported, but a candidate that touches a
base span is not; repeated rows give repeated results; an empty table trains from the digests and WORDS alone and gives no rows; a column
named secret_spans is replaced, all others pass through untouched, whatever their names.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sampled

#: Fixed patterns and the least length of a match (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "random")

ALPHABET = string.ascii_letters + string.digits + "+/_=-"
SPANS = "array<struct<start:int,kind_no:int,stop:int,hit:string>>"
RUN = r"(?<![A-Za-z0-9+/_=\ufdd0-])[A-Za-z0-9+/_=-]{20,}+(?!\ufdd0)"
LONE_WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,19}(?![A-Za-z0-9+/_=-])"
#: Words of ordinary identifiers, part of every ordinary sample, so that tables without words train too.
WORDS = (
    "account action address array author base block body build byte cache call cell check child class client code column comment config connection content context copy count create customer data date "
    "default delete detail device document element email entry error event example field file filter find first folder form format function group handle header height history host image index input "
    "instance item key label language last length level line link list load local location manager map message method model module name network node number object option order output page parameter "
    "parent part path pattern price process product project property query range reader record reference region release report request resource response result return root row rule sample schema "
    "search section select server service session set shape size source start state status string style submodel table target task template text thread time title total type unit update user value version view width window write"
)
#: Rows of the ordinary sample are those whose hash falls below a share of the table that yields about so many documents, and the first so many of their words by hash.
ORDINARY_DOCUMENTS, ORDINARY_WORDS = 64, 2000
RANDOM_STRINGS = 1000
#: Times that WORDS count, beside the distinct words of the documents.
OWN_WORDS = 10
UNSEEN = 0.2
#: Nats that a pair of neighbours has to bring, and those above that from which a stretch counts as random.
DRIFT, LEAST_RATIO = 0.5, 16.0
#: Matches of a fold.
FOLD = 64
#: Stands for a blanked character: one that no text should hold; those that do lose it for the search of candidates.
BLANK = "\ufdd0"


def labelled_samples(spark: SparkSession, df: DataFrame, text_col: str = "text") -> DataFrame:
    """(random boolean, token string): made-up random strings, and words of a bounded sample of df in the shapes of identifiers."""
    rows = df.count()
    digest = F.sha2(F.concat(F.lit("seed"), F.col("id").cast("string")), 256)
    base64 = F.base64(F.unhex(digest))
    made = spark.range(RANDOM_STRINGS).select(F.lit(True).alias("random"), F.explode(F.array(digest, F.upper(digest), base64, F.translate(base64, "+/=", "-_"), F.upper(base64), F.lower(base64))).alias("token"))
    share = min(1.0, ORDINARY_DOCUMENTS / rows) if rows else 1.0
    picked = df.select(F.col(f"`{text_col}`").alias("text")).filter(sampled("text", share)).distinct()
    words = picked.select(F.explode(F.regexp_extract_all("text", F.lit(LONE_WORD), F.lit(0))).alias("word")).distinct().orderBy(F.xxhash64("word"), "word").limit(ORDINARY_WORDS)
    words = words.unionAll(spark.range(OWN_WORDS).select(F.explode(F.split(F.lit(WORDS), " ")).alias("word")))
    low, head, up = F.lower("word"), F.initcap("word"), F.upper("word")
    digits = F.right(F.pmod(F.xxhash64("word"), F.lit(10**9)).cast("string"), F.pmod(F.xxhash64("word", F.lit(1)), F.lit(8)).cast("int") + 1)
    pairs = [F.concat(a, F.lit(x), a) for x in "_-/=+" for a in (low, head, up)] + [F.concat(digits, F.lit(x), digits) for x in "_-/"]
    shapes = F.array(low, up, head, F.concat(low, head), F.concat(head, head), *pairs, *(F.concat(a, F.lit(x), digits) for x in ("", "_", "-", "/", "=") for a in (low, head, up)), F.concat(digits, low))
    return made.unionByName(words.select(F.lit(False).alias("random"), F.explode(shapes).alias("token")))


def ratio_table(samples: DataFrame) -> list[float]:
    """log P(b | a, random) / P(b | a, ordinary) for all a, b of ALPHABET, row by row; unseen pairs count UNSEEN."""
    pairs = samples.select("random", F.explode(F.expr("transform(sequence(1, greatest(length(token) - 1, 1)), i -> substring(token, i, 2))")).alias("pair"))
    pairs = pairs.filter(F.length("pair") == 2).groupBy("random", "pair").agg(F.count(F.lit(1)).alias("n"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.collect()}
    logs = {}
    for random in (True, False):
        for a in ALPHABET:
            total = sum(counts.get((random, a + b), 0) for b in ALPHABET)
            for b in ALPHABET:
                logs[random, a + b] = math.log((counts.get((random, a + b), 0) + UNSEEN) / (total + UNSEEN * len(ALPHABET)))
    return [round(logs[True, a + b] - logs[False, a + b], 6) for a in ALPHABET for b in ALPHABET]


def best_stretch(token: Column, table: list[float]) -> Column:
    """The highest sum, over stretches of token, of the table's entries less DRIFT for neighbouring characters."""
    # a constant that the optimiser folds, written as one string
    constant = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(kind)
    rows = constant(table, "array<double>")
    place = {ord(c): i for i, c in enumerate(ALPHABET)}
    places = constant([place.get(i, -1) for i in range(128)], "array<int>")
    numbers = F.transform(F.split(token, ""), lambda c: F.get(places, F.ascii(c)))
    pairs = F.zip_with(F.slice(numbers, 1, F.length(token) - 1), F.slice(numbers, 2, F.length(token) - 1), lambda a, b: F.coalesce(F.get(rows, a * len(ALPHABET) + b), F.lit(0.0)) - DRIFT)
    start = F.struct(F.lit(0.0).alias("now"), F.lit(0.0).alias("best"))
    step = lambda acc, x: F.struct(F.greatest(acc["now"] + x, F.lit(0.0)).alias("now"), F.greatest(acc["best"], acc["now"] + x).alias("best"))
    return F.aggregate(pairs, start, step, lambda acc: acc["best"])


def spans_of(parts: Column, hits: Column, kind: str) -> Column:
    """Array of (start, kind_no, stop, hit), in code points, of all hits of a kind, where parts are the stretches of text before, between and after them."""
    # a fold copies what it has gathered, so one goes over FOLD matches only and a second one over the runs of them
    ends = F.zip_with(F.slice(parts, 1, F.greatest(F.size(hits), F.lit(0))), hits, lambda p, h: F.length(p) + F.length(h))
    runs = F.sequence(F.lit(0), F.ceil(F.size(hits) / FOLD).cast("int") - 1)
    sums = F.transform(runs, lambda r: F.aggregate(F.slice(ends, r * FOLD + 1, FOLD), F.lit(0), lambda a, x: a + x))
    begins = F.aggregate(
        sums, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"],
    )
    number = KINDS.index(kind)

    def run(begin: Column, r: Column) -> Column:
        last = F.least((r + 1) * FOLD, F.size(hits))

        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + F.length(F.get(parts, i))
            stop = start + F.length(F.get(hits, i))
            span = F.struct(start.alias("start"), F.lit(number).alias("kind_no"), stop.alias("stop"), F.get(hits, i).alias("hit"))
            return F.struct(stop.alias("at"), F.concat(acc["found"], F.array(span)).alias("found"))

        return F.aggregate(F.sequence(r * FOLD, last - 1), F.struct(begin.alias("at"), F.array().cast(SPANS).alias("found")), step, lambda acc: acc["found"])

    return F.when(F.size(hits) > 0, F.flatten(F.transform(begins, run))).otherwise(F.array().cast(SPANS))


def blanked(parts: Column, hits: Column, counts) -> Column:
    """The text again, hits that count as blanks of their length."""
    return F.array_join(F.zip_with(parts, hits, lambda p, h: F.concat(p, F.when(h.isNull(), "").when(counts(h), F.repeat(F.lit(BLANK), F.length(h))).otherwise(h))), "")


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with added columns that are computed once for each row, however often later expressions use them."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def counts_as_assign(hit: Column) -> Column:
    return F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8


def find_secrets(df: DataFrame, text_col: str = "text", train_on: DataFrame | None = None) -> DataFrame:
    """df with `secret_spans`, an array of (start, kind_no, stop, hit) ordered by start, then kind: see KINDS."""
    table = ratio_table(labelled_samples(df.sparkSession, df if train_on is None else train_on, text_col))
    kept = [F.col(f"`{c}`") for c in df.columns if c != "secret_spans"]
    # the caller's columns travel in one struct, so that none of them can clash with those made on the way
    found = df.select(F.struct(*kept).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
    found = settled(found, **{f"{k}_hits": F.regexp_extract_all("text", F.lit(p), F.lit(0)) for k, p in patterns.items()})
    # lengths of what a split by the same pattern leaves give the positions
    found = settled(found, **{f"{k}_parts": F.when(F.size(f"{k}_hits") > 0, F.split("text", p, -1)).otherwise(F.array(F.lit(""))) for k, p in patterns.items()})
    found = settled(found, **{k: spans_of(F.col(f"{k}_parts"), F.col(f"{k}_hits"), k) for k in patterns})
    found = settled(found, base=F.concat(F.filter("assign", lambda s: counts_as_assign(s["hit"])), "access", "hex"))
    # blanked kind by kind: what an earlier kind has blanked of a later one's match leaves a rest beside a blank, where no candidate stands
    plain = lambda c: F.replace(c, F.lit(BLANK), F.lit(" "))
    found = settled(found, free=F.when(F.size("assign_hits") > 0, blanked(F.transform("assign_parts", plain), F.col("assign_hits"), counts_as_assign)).otherwise(plain(F.col("text"))))
    for kind in ("access", "hex"):
        hits = F.regexp_extract_all("free", F.lit(patterns[kind]), F.lit(0))
        found = settled(found, free_next=F.when(F.size(f"{kind}_hits") > 0, blanked(F.split("free", patterns[kind], -1), hits, lambda h: F.lit(True))).otherwise(F.col("free"))).drop("free").withColumnRenamed("free_next", "free")
    found = settled(found, run_hits=F.regexp_extract_all("free", F.lit(RUN), F.lit(0)))
    found = settled(found, run=spans_of(F.when(F.size("run_hits") > 0, F.split("free", RUN, -1)).otherwise(F.array(F.lit(""))), F.col("run_hits"), "random"))

    def random(s: Column) -> Column:
        return s["hit"].rlike("[0-9]") & s["hit"].rlike("[A-Za-z]") & (best_stretch(s["hit"], table) >= LEAST_RATIO)

    spans = F.array_sort(F.concat("base", F.filter("run", random)))
    return settled(found, secret_spans=spans).select("row.*", "secret_spans")


def redact(df: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """df, of find_secrets, with every span of its text replaced by mask; rows without a span keep their text as it is."""
    text = F.col(f"`{text_col}`")

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, acc["at"], F.greatest(s["start"] + 1 - acc["at"], F.lit(0)))
        shown = F.when(s["stop"] + 1 > acc["at"], F.lit(mask)).otherwise("")
        return F.struct(F.greatest(acc["at"], s["stop"] + 1).alias("at"), F.concat(acc["parts"], F.array(F.concat(before, shown))).alias("parts"))

    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"], F.length(text)))
    return df.withColumn(text_col, F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", start, step, rest)).otherwise(text))


def joined(spans: Column) -> Column:
    """kind:start:stop of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_no"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of find_secrets that can be held against a scan by the fixed patterns alone."""
    base = F.filter("secret_spans", lambda s: s["kind_no"] < 3)

    def count(n: int) -> Column:
        return F.size(F.filter("secret_spans", lambda s: s["kind_no"] == n)).cast("long").alias(f"n_{KINDS[n]}")

    return found.select("doc_id", *map(count, range(3)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secret_spans")).alias("spans"))
