"""Personal data: pattern spans and information-theoretic sanitisation (operator 5); DataFrame operations only.

The base spans are found by regular expressions.  Each stands for a protected entity (the normalised
address or number).  All terms (words of at least three letters outside addresses) of the documents that hold an entity
are candidates for disclosure.  Over all documents it is counted how many hold the entity, the term, and both; the
share of the entity's information that the term reveals is

    log(both * N / (entity * term)) / log(N / entity)        (pointwise mutual information / information content)

A term that reveals at least ``remove`` is removed, at least ``generalise`` replaced by a general word,
given ``support`` documents; at every place it has in documents that hold the entity, but only there, so documents without personal data
stay as they are.  Spans of the method are of the kinds ``removed`` and ``generalised``, after the four of the base.  Terms are counted over the whole
corpus where they stand; of these counts those of terms that meet an entity in ``support`` documents are kept.

The patterns run with possessive loops and start only where a run of their first class starts or where the
last match ended (``\\G``): the matches are those of the plain patterns, but no text makes them
backtrack quadratically or recurse.  Positions are code points, found from the lengths of what lies between matches.

Spans depend on the text alone, so they are joined by its SHA-256: copies share one entry and repeated or
null doc_ids are no trouble.  Defined cases: null text has no spans and stays null; no document with personal data
means no added spans; a term that is to be removed for one entity and generalised for another is removed; a very long text is scanned whole, in one row's
memory; an empty table gives an empty result; extra columns pass through, one named like an output (n_email, n_ip, n_card, n_phone, base, base_sha256, spans, in any
case) is replaced by ``personal_data``; ``sanitised`` returns all columns of docs, only the text changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runstore.llm.common import columns_but, kept, quoted

#: The kinds in their order, as (pattern, what a text must contain).
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = list(PATTERNS)
LETTERS = r"\p{L}{3,}+"
SUPPORT, REMOVE, GENERALISE = 3, 0.95, 0.8
LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": "", "generalised": "[TERM]"}
_BLOCK = 256
_made = ["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "base_sha256", "_key", "_plain", "_added"]


def _running(lengths):
    """Running sums before each entry of an int array, in two levels so that long arrays don't copy much."""

    def sums(values, get):
        zero = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("all"))
        return F.aggregate(values, zero, lambda acc, x: F.struct((acc["sum"] + get(x)).alias("sum"), F.concat(acc["all"], F.array(acc["sum"])).alias("all")))

    n = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), lambda b: sums(F.slice(lengths, b * _BLOCK + 1, F.lit(_BLOCK)), lambda x: x))
    spread = lambda inner: F.flatten(F.zip_with(inner, sums(inner, lambda x: x["sum"])["all"], lambda b, base: F.transform(b["all"], lambda x: x + base)))
    return F.when(n > 0, _let(blocks, spread)).otherwise(F.array().cast("array<int>"))


def _let(value, body):
    """body(value) with the value computed once: functions with lambdas share no common subexpressions."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(text, pattern: str):
    """Matches as array<struct<start, end, value>> in code points."""

    def of(found, gaps):
        sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: g + F.length(m))
        pairs = F.zip_with(found, gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        place = lambda at, x: F.when(x["m"].isNotNull(), F.struct((at + x["g"]).alias("start"), (at + x["g"] + F.length(x["m"])).alias("end"), x["m"].alias("value")))
        return F.zip_with(_let(sizes, _running), pairs, place)

    found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    gaps = lambda t: F.transform(F.split(t, pattern, -1), lambda g: F.length(g))
    return _let(text, lambda t: _let(found(t), lambda f: _let(gaps(t), lambda g: of(f, g))))


def _luhn(digits):
    """Whether the checksum of a string of digits holds; every second digit from the right is doubled."""
    single = lambda d, i: F.substring(d, i, F.lit(1)).cast("int")
    value = lambda b, i: F.when(i % 2 == 1, single(b, i)).otherwise(single(F.translate(b, "0123456789", "0246813579"), i))
    return _let(F.reverse(digits), lambda b: F.aggregate(F.sequence(F.lit(1), F.length(b)), F.lit(0), lambda acc, i: acc + value(b, i))) % 10 == 0


def _valid(kind: str, value):
    digits = F.regexp_replace(value, "[^0-9]+", "")
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return _let(digits, lambda d: F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs plus ``base``: array<struct<start, k, end, kind, value>> by start and then kind."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    own = [quoted(c) for c in columns_but(docs, _made)]
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    found = docs.select(*own, *[F.when(t.contains(needs) if needs else t.rlike("[0-9]"), _places(t, p)).otherwise(empty).alias(f"_{k}") for k, (p, needs) in PATTERNS.items()])
    # only as many entries as matches: the gaps have one more, which zip_with pads with null
    sound = lambda k: F.filter(f"_{k}", lambda s: s.isNotNull() & _valid(k, s["value"]))
    named = lambda i, k: F.transform(sound(k), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value")))
    return found.select(*own, F.sort_array(F.concat(*[named(i, k) for i, k in enumerate(KINDS)])).alias("base"))


def _entity(span):
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(F.regexp_replace(span["value"], "[^0-9]+", "")))


def _words(plain):
    """The distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(LETTERS), F.lit(0)), lambda x: F.lower(x)))


def _plain(text):
    """The text with its addresses, which hold letters, blanked out, so that no part of one counts as a term; same length."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS["email"][0]), F.lit(0))
    pieces = F.zip_with(F.split(text, PATTERNS["email"][0], -1), found, lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit("0"), F.length(m)), F.lit(""))))
    return F.when(text.contains("@"), F.array_join(pieces, "")).otherwise(text)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, plus base, _plain (only where base has spans) and _key (the text's SHA-256), written once."""
    t = F.coalesce(F.col(quoted(text)), F.lit(""))
    keyed = base_spans(docs, text).withColumn("_key", F.unhex(F.sha2(t, 256))).withColumn("_plain", F.when(F.size("base") > 0, _plain(t)))
    return kept(keyed.drop(F.col(quoted(text))), "scan")


def entities(found: DataFrame) -> DataFrame:
    """(_key, entity, n): the entities of each distinct text and how many documents have that text."""
    texts = found.where(F.size("base") > 0).groupBy("_key").agg(F.count("*").alias("n"), F.first("base").alias("base"))
    return texts.select("_key", "n", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))


def disclosures(docs: DataFrame, found: DataFrame, text: str = "text", support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """(entity, term, share, action) of the terms that reveal too much, from counts over all documents."""
    total = found.agg(F.count("*").cast("double").alias("total"))
    own = entities(found)
    # an entity of fewer documents than the support has no term with it
    entity = own.groupBy("entity").agg(F.sum("n").alias("with_entity")).where(F.col("with_entity") >= support)
    open_ = own.join(entity.select("entity"), "entity", "left_semi")
    plain = found.where(F.size("base") > 0).select("_key", "_plain").dropDuplicates(["_key"]).select("_key", _words(F.col("_plain")).alias("terms"))
    both = open_.join(plain, "_key").select("entity", "n", F.explode("terms").alias("term"))
    both = kept(both.groupBy("entity", "term").agg(F.sum("n").alias("both")).where(F.col("both") >= support), "together")
    # counted where they stand and written: the optimiser takes a semi join below the count, and if it isn't a broadcast after all, each term of each document moves
    term = docs.select(F.explode(_words(_plain(F.col(quoted(text))))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    term = kept(term, "terms").join(both.select("term").distinct(), "term", "left_semi")
    all_ = both.join(entity, "entity").join(term, "term").crossJoin(F.broadcast(total))  # total: one row
    content = F.log(F.col("total") / F.col("with_entity"))
    share = F.when(content > 0, F.log(F.col("both") * F.col("total") / (F.col("with_entity") * F.col("with_term"))) / content).otherwise(0.0)
    return all_.select("entity", "term", share.alias("share")).where(F.col("share") >= generalise).withColumn("action", F.when(F.col("share") >= remove, "removed").otherwise("generalised"))


def added_spans(found: DataFrame, revealed: DataFrame) -> DataFrame:
    """(_key, _added): every occurrence of the terms that reveal an entity of the text, wherever it stands."""
    hits = entities(found).join(revealed, "entity").groupBy("_key", "term").agg(F.max("action").alias("action"))  # removed wins over generalised
    texts = found.where(F.size("base") > 0).select("_key", "_plain").dropDuplicates(["_key"]).join(hits.select("_key").distinct(), "_key", "left_semi")
    places = texts.select("_key", F.explode(F.filter(_places(F.col("_plain"), LETTERS), lambda x: x.isNotNull())).alias("x"))
    places = places.select("_key", F.lower("x.value").alias("term"), "x.start", "x.end")
    spans = F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("k"), "end", F.col("action").alias("kind")))
    return places.join(hits, ["_key", "term"]).groupBy("_key").agg(F.sort_array(spans).alias("_added"))


def _joined(spans):
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def _short(spans):
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))


def personal_data(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """docs without the text, plus the counts, base_sha256 and spans (all of them, kind:start:end)."""
    own = [c for c in columns_but(docs, _made) if c.lower() != text.lower()]
    docs = docs.select(*[quoted(c) for c in own], quoted(text))
    found = scan(docs, text)
    added = added_spans(found, kept(disclosures(docs, found, text, **limits), "disclosures"))
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    all_ = found.join(added, "_key", "left").withColumn("_all", F.sort_array(F.concat(_short("base"), F.coalesce("_added", none))))
    number = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [number(k) for k in KINDS]
    return all_.select(*[quoted(c) for c in own], *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("_all")).alias("spans"))


def sanitised(docs: DataFrame, text: str = "text", **limits) -> DataFrame:
    """docs with personal data replaced by labels, revealing terms removed or generalised.

    Rows are written once with their spans; only those that hold personal data are joined with the terms to remove.
    """
    own = docs.columns
    slim = docs.select(F.struct(*[quoted(c) for c in own]).alias("_doc"), F.col(quoted(text)).alias("text"))
    found = scan(slim, "text")
    added = added_spans(found.drop("_doc"), kept(disclosures(slim.select("text"), found.drop("_doc"), "text", **limits), "disclosures"))
    none = F.array().cast("array<struct<start:int,k:int,end:int,kind:string>>")
    touched = found.where(F.size("base") > 0).join(added, "_key", "left")
    touched = touched.select("_doc", F.col("_doc")[text].alias("_t"), F.sort_array(F.concat(_short("base"), F.coalesce("_added", none))).alias("_all"))
    # a span that begins inside what was replaced before it is part of that replacement
    t = F.col("_t")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    label = lambda s: F.create_map(*[F.lit(x) for kv in LABEL.items() for x in kv])[s["kind"]]
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), label(s)))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate("_all", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))))
    clean = found.where(F.size("base") == 0).select(*[F.col("_doc")[c].alias(c) for c in own])
    return clean.unionByName(touched.select(*[(done if c == text else F.col("_doc")[c]).alias(c) for c in own]))
