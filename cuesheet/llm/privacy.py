"""Personal data: patterns for protected values, and terms that give them away, with DataFrame functions only.

Protected values are found by pattern. A value stands for several entities: itself, and the part of it that other values share (an address's
host, an IP's network, a card's issuer, a phone's area). A term (a word of at least TERM_LETTERS letters) within WINDOW characters of a
value, or in the name part of an e-mail address, is its company. Everything is counted in distinct texts, so that copies of a
document are one piece of evidence: with N of them, n(c) that hold entity c, n(t) that hold term t and n(c,t) in which c has t in its company, a
term discloses
    log(n(c,t) N / (n(c) n(t))) / log(N / n(c))
of what there is to know about c: their pointwise mutual information over c's information content, 1 for a term never seen
without c. Two kinds of evidence make a term personal data itself:
- it was seen with an entity in SUPPORT different surroundings or more, and discloses DISCLOSED or more of it;
- it was seen with a whole value, if only once (most values occur once), discloses SINGLE or more, is rare, and wouldn't be met there by chance. A term is
  rare if its number of texts, less two standard deviations of such a count, is at most one of RARE; chance is the probability that n(c,t) texts dealt
  blindly all hold c, (n(c) / N) ** n(c,t), and CHANCE or less is asked for. Both hold alike for any number of texts.
Each occurrence of such a term outside the values, on single evidence in the texts where it was in a value's company, on repeated evidence in any text, is
a span of kind `term`. `sanitised` generalises values and terms to their kind.

The patterns mean what the plain ones in PLAIN mean, leftmost and non-overlapping, but can't go back over a long run of characters.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuesheet.llm.common import table, written

# The kinds in order, and the pattern of each.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": PLAIN["phone"],
}
KINDS = (*PLAIN, "term")
WINDOW, TERM_LETTERS, SUPPORT, DISCLOSED, SINGLE, RARE, CHANCE = 60, 3, 3, 0.7, 0.9, 1000, 0.001
TERM = rf"\p{{L}}{{{TERM_LETTERS},}}"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits has a right check digit."""
    n = F.length(number)
    digit = lambda i: F.substring(number, n - i, F.lit(1)).cast("int")  # noqa: E731  from the last
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda x: x.cast("double") <= 255),
    "card": lambda v: F.length(digits(v)).between(12, 19) & luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(9, 15),
}


def valid(kind: str) -> Callable[[Column], Column]:
    return lambda span: VALID[kind](span["value"])


def of_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


#: what a text must hold for a kind to be looked for
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SPAN = "struct<start: int, end: int, kind: int, value: string>"


def matches(text: Column, pattern: Column, kind: int) -> Column:
    """All matches with their places: what is between them, by its length, says where they are."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), m.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + x["gap"]
        span = F.struct(first.alias("start"), (first + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))
        return F.struct((first + x["size"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> Column:
    """Valid values of all kinds, by start and then kind."""
    none, parts = F.array().cast(f"array<{SPAN}>"), []
    for k, kind in enumerate(PLAIN):
        found = F.filter(matches(text, F.lit(PATTERNS[kind]), k), valid(kind))
        needed = NEEDED[kind]
        parts.append(F.when(F.contains(text, F.lit(needed)) if needed else text.rlike("[0-9]"), found).otherwise(none))
    # structs sort by start, end, kind; starts come first and kinds next
    keyed = F.transform(F.concat(*parts), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.array_sort(keyed)


def entities(kind: Column, value: Column) -> Column:
    """The value, and the part of it that others share, each with its kind."""
    parts = F.array(F.substring_index(F.lower(value), "@", -1), F.substring_index(value, ".", 3), F.substring(digits(value), 1, 6), F.substring(digits(value), 1, 6))
    return F.array(F.concat_ws(":", kind, F.lower(value)), F.concat_ws("/", kind, F.element_at(parts, kind + 1)))


def surroundings(text: Column, spans: Column) -> Column:
    """Of each value its company: the distinct terms on either side and in an address's name, and a hash of both sides."""

    def one(s: Column) -> Column:
        first = F.greatest(F.lit(0), s["start"] - WINDOW)
        left = F.substring(text, first + 1, s["start"] - first)
        left = F.when(first > 0, F.regexp_replace(left, r"^\p{L}+", "")).otherwise(left)
        right = F.regexp_replace(F.substring(text, s["end"] + 1, F.lit(WINDOW)), r"\p{L}+$", "")
        name = F.when(s["kind"] == 0, F.substring_index(s["value"], "@", 1))
        terms = F.array_distinct(F.regexp_extract_all(F.lower(F.concat_ws(" ", left, right, name)), F.lit(TERM), F.lit(0)))
        return F.struct(entities(s["kind"], s["value"]).alias("entities"), F.xxhash64(left, right).alias("around"), terms.alias("terms"))

    return F.transform(spans, one)


#: two hashes that name a text
KEY = ["h1", "h2"]
#: of the bitmap of terms: bits for each term, places of a term, and the most bits as a power of two
TERM_BITS, TERM_PLACES, MOST_BITS = 64, 4, 26


def revealing_terms(found: DataFrame, texts: DataFrame, support: int = SUPPORT, disclosed: float = DISCLOSED, single: float = SINGLE, rare: int = RARE) -> DataFrame:
    """(term, entity, disclosure, often) from distinct texts (h1, h2, text) and their company (h1, h2, company); often: by repeated evidence."""
    n_docs = texts.count()
    company = found.select(*KEY, F.explode("company").alias("c")).select(*KEY, F.posexplode("c.entities").alias("part", "entity"), "c.around", "c.terms").dropDuplicates(["entity", "around", *KEY])
    # distinct counts are put together in tasks first, so that a very common entity is a row for each task, text and surroundings
    values = company.select("entity", *KEY).distinct().groupBy("entity").agg(F.count("*").alias("n_c"))
    pairs = company.select("entity", "part", F.explode("terms").alias("term"), *KEY, "around").groupBy("entity", "part", "term").agg(F.count_distinct(*KEY).alias("n_ct"), F.count_distinct("around").alias("places"))
    candidates = written(pairs.where((F.col("places") >= support) | (F.col("part") == 0)).join(values, "entity").where(F.col("n_c") < n_docs))
    if candidates.isEmpty():
        return candidates.select("term", "entity", F.lit(0.0).alias("disclosure"), F.lit(True).alias("often"))
    held = texts.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    share = F.log(F.col("n_ct") * n_docs / (F.col("n_c") * F.col("n_t"))) / F.log(F.lit(n_docs) / F.col("n_c"))
    judged = held.join(candidates, "term").withColumn("disclosure", F.least(share, F.lit(1.0)))
    often = (F.col("places") >= support) & (F.col("disclosure") >= disclosed)
    chance = F.pow(F.col("n_c") / n_docs, F.col("n_ct"))
    once = (F.col("part") == 0) & ((F.col("n_t") - 2 * F.sqrt("n_t")) * rare <= n_docs) & (chance <= CHANCE) & (F.col("disclosure") >= single)
    return judged.where(often | once).select("term", "entity", "disclosure", often.alias("often"))


def terms_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def holding(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """Texts that may hold some of the terms (distinct), with these: adds maybe. A Bloom filter of 2 ** MOST_BITS bits at most, one row beside each text, tells."""
    size = 1 << min(MOST_BITS, max(16, (terms.count() * TERM_BITS).bit_length()))
    at = lambda term, k: (F.pmod(F.xxhash64(term), F.lit(size)) + k * F.pmod(F.xxhash64(F.lit(7), term), F.lit(size))) % size
    places = terms.select(F.explode(F.array(*(at("term", k) for k in range(TERM_PLACES)))).alias("at"))
    bits = places.groupBy(F.floor(F.col("at") / 64).cast("int").alias("i")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("b"))
    every = texts.sparkSession.range(size // 64).select(F.col("id").cast("int").alias("i")).join(bits, "i", "left").select("i", F.coalesce("b", F.lit(0)).alias("b"))
    one = every.agg(F.array_sort(F.collect_list(F.struct("i", "b"))).alias("x")).select(F.transform("x", lambda x: x["b"]).alias("bitmap"))
    known = lambda at: F.getbit(F.element_at("bitmap", F.floor(at / 64).cast("int") + 1), (at % 64).cast("int")) == 1
    some = F.filter(terms_of(F.col("text")), lambda t: reduce(and_, (known(at(t, k)) for k in range(TERM_PLACES))))
    return texts.crossJoin(F.broadcast(one)).select(*texts.columns, some.alias("maybe")).where("size(maybe) > 0")


PLACED = "array<struct<start: int, kind: int, end: int, value: string>>"


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: int = SUPPORT, disclosed: float = DISCLOSED, single: float = SINGLE, rare: int = RARE, shown: Callable[[Column], Column] = lambda c: c) -> DataFrame:
    """(doc_id, base, added, clean) of every row: the spans of values, of terms that disclose them, and the text with both generalised.

    Spans are structs (start, kind, end, value), kind a number in KINDS, in code points with the end exclusive, in order. `shown` is applied to
    clean texts before they are joined to their rows, such as a digest. Null texts count as empty and have no spans. Texts of any length are read
    whole. Repeated rows and texts are treated alike; rows without doc_id are rows like any other; other columns are ignored; an empty
    table gives no rows.
    """
    plain = F.coalesce(text, F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), plain.alias("text"), F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(7), plain).alias("h2"))
    texts = written(rows.select(*KEY, "text").dropDuplicates(KEY))
    spans = texts.select(*KEY, "text", base_spans(F.col("text")).alias("base")).where("size(base) > 0")
    valued = written(spans.withColumn("company", surroundings(F.col("text"), F.col("base"))))
    terms = written(revealing_terms(valued, texts, support, disclosed, single, rare))
    # a term of single evidence is marked where it was beside the value, so that a value of many texts doesn't bring each one's terms to all; one of repeated evidence everywhere
    beside = valued.select(*KEY, F.explode("company").alias("c")).select(*KEY, F.element_at("c.entities", 1).alias("entity"), F.explode("c.terms").alias("term"))
    near = beside.join(terms.where("not often").select("term", "entity"), ["term", "entity"]).select(*KEY, "term")
    none, marked = F.array().cast(PLACED), valued.select(*KEY, "text", "base")
    often = written(terms.where("often").select("term").distinct())
    if not often.isEmpty():
        some = written(holding(texts, often))
        near = near.union(some.select(*KEY, F.explode("maybe").alias("term")).join(often, "term").select(*KEY, "term"))
        marked = marked.union(some.join(valued.select(*KEY), KEY, "left_anti").select(*KEY, "text", none.alias("base")))
    by_text = near.groupBy(*KEY).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("terms", "|"), F.lit(r")(?!\p{L})"))
    ordered = F.transform(matches(F.col("text"), pattern, len(PLAIN)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    apart = F.filter(ordered, lambda s: ~F.exists("base", lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))
    made = marked.join(by_text, KEY, "left").select(*KEY, "text", "base", F.when(F.col("terms").isNull(), none).otherwise(apart).alias("added"))
    made = written(made.select(*KEY, "base", "added", shown(sanitised(F.col("text"), F.concat("base", "added"))).alias("clean")))
    found = rows.select("doc_id", *KEY, shown(F.col("text")).alias("own")).join(made, KEY, "left")
    return found.select("doc_id", F.coalesce("base", none).alias("base"), F.coalesce("added", none).alias("added"), F.coalesce("clean", "own").alias("clean"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one, of the first's kind."""
    names = F.array(*map(F.lit, KINDS))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        shown = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(F.element_at(names, s["kind"] + 1)), F.lit(">"))
        apart = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], F.array(shown))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(F.array_sort(spans), start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"), shown=lambda text: F.sha2(text, 256))
    counts = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(PLAIN)]
    spans = listed(F.array_sort(F.concat("base", "added"))).alias("spans")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), spans, F.size("added").cast("long").alias("n_term"), F.col("clean").alias("clean_sha256"))
