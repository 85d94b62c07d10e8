"""Information-theoretic sanitisation: personal data by pattern, and terms that reveal it by corpus co-occurrence.

DataFrame functions only. A match's place is what the pieces around the matches add up to, so no code walks the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixeltide.llm.common import stored

# Patterns of the base kinds. Possessive repeats match the same strings as plain ones here (what follows a repeat is never part
# of it) and keep the matcher from recursing or backing up on very long runs; a match may start only where no earlier start would do.
_START = r"(?:\G|(?<![{0}]))"
PATTERNS = {
    "email": _START.format(r"A-Za-z0-9._%+-") + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": _START.format("0-9") + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}
#: Code points on either side of a match that tell its surroundings: mentions with equal ones are copies and one piece of evidence.
WINDOW = 120
#: A term reveals an entity if it tells this share of its information.
DISCLOSURE = 0.9
#: And if of all terms and entities of the corpus at most so many pairs are expected to meet as often by chance.
CHANCE = 1.0
#: Revealing terms (or pairs of entity and term) up to this number, and code points in all, travel with the code, so that texts are searched
#: where they lie; more are joined to the words of the texts.
CARRIED, CARRIED_CHARS = 50_000, 4_000_000
#: Buckets of carried terms.
BUCKETS = 1 << 14
#: Parts that the documents of one word are dealt to when revealing terms are looked up by a join.
PARTS = 32
_WORD = r"\p{L}++"
_SPAN = "struct<kind:string,begin:int,end:int,value:string>"


def _placed(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<kind, begin, end, value>> of the leftmost matches, code points, end exclusive."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    around = F.split(text, pattern, -1)
    both = F.zip_with(F.slice(around, F.lit(1), F.size(found)), found, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, item: Column) -> Column:
        begin = state["at"] + item["gap"]
        end = begin + F.length(item["value"])
        span = F.struct(F.lit(kind).alias("kind"), begin.alias("begin"), end.alias("end"), item["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(span)).alias("spans"))

    return F.aggregate(both, start, step, lambda state: state["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits pass the check sum: from the right, every second digit doubled, its digits added."""
    n = F.length(digits)
    place = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d >= 5, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(place, F.lit(0), lambda a, i: a + F.coalesce(value(i), F.lit(0))) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda part: part.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])$"))
    digits = _digits(value)
    if kind == "card":
        # Lengths first: the sum is worked out for cards only.
        return F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _test_of(kind: str):
    return lambda span: _holds(kind, span["value"])


def base_spans(text: Column) -> Column:
    """All base spans of a text (null: none), by kind as listed, then by place."""
    nothing = F.array().cast(f"array<{_SPAN}>")
    parts = []
    for kind, pattern in PATTERNS.items():
        may = text.contains(_SIGN[kind]) if _SIGN[kind] else text.rlike("[0-9](?:[\\x20-]?[0-9]){12}")
        spans = F.filter(_placed(text, pattern, kind), _test_of(kind))
        parts.append(F.when(may, spans).otherwise(nothing))
    return F.concat(*parts)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["begin"], s["end"])), ",")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(real_id, id, text_hash, text): id and text_hash tell texts apart even where ids are null or repeat."""
    unknown = F.lit(-(1 << 63)).cast("long")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("real_id"), text.alias("text"))
    return source.select("real_id", F.coalesce("real_id", unknown).alias("id"), F.xxhash64("text").alias("text_hash"), "text")


def _cut(text: Column, spans: Column, label) -> Column:
    """text with spans (in order; those that overlap as one) replaced by what ``label`` makes of the first."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, state["at"] + 1, s["begin"] - state["at"])
        end = F.greatest(state["at"], s["end"])
        parts = F.when(s["begin"] < state["at"], state["parts"]).otherwise(F.concat(state["parts"], F.array(gap, label(s))))
        return F.struct(end.alias("at"), parts.alias("parts"))

    finish = lambda state: F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def _place(s: Column) -> Column:
    return F.struct(s["begin"].alias("begin"), s["end"].alias("end"), s["kind"].alias("kind"))


def _words(text: Column) -> Column:
    """The different words of a text, each lower-cased by itself."""
    return F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))), F.lower))


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(real_id, id, text_hash, spans, entities, words, inner) of every row.

    entities has the entity of each base span with a hash of the text around it. words are the different words outside base spans
    and inner those that stand inside only; both are null for rows without spans.
    """
    source = _keyed(docs, id_col, text_col).withColumn("spans", base_spans(F.col("text")))

    def mention(s: Column) -> Column:
        left_at = F.greatest(s["begin"] - WINDOW, F.lit(0))
        left = F.substring(F.col("text"), left_at + 1, s["begin"] - left_at)
        right = F.substring(F.col("text"), s["end"] + 1, F.lit(WINDOW))
        return F.struct(F.concat(s["kind"], F.lit(":"), F.lower(s["value"])).alias("entity"), F.xxhash64(left, right).alias("around"))

    # A word that is part of a span is no term, one that touches it is.
    rest = _cut(F.col("text"), F.sort_array(F.transform("spans", _place)), lambda s: F.lit("0"))
    some = F.size("spans") > 0
    source = source.withColumns({"words": F.when(some, _words(rest)), "entities": F.transform("spans", mention)})
    inner = F.when(some, F.array_except(_words(F.col("text")), "words"))
    return source.select("real_id", "id", "text_hash", "spans", "entities", "words", inner.alias("inner"))


def disclosing(found: DataFrame, docs: DataFrame, text_col: str = "text", chance: float = CHANCE, disclosure: float = DISCLOSURE) -> DataFrame:
    """(entity, term, disclosed): the pairs that reveal.

    A term tells log2(N n(t, e) / (n(t) n(e))) of the log2(N / n(e)) bits of an entity, N being the texts of the corpus, n(t) and n(e)
    those that hold term and entity, n(t, e) those that hold both, wherever in the text. Copies count everywhere alike, so they cancel.

    Evidence is counted in different surroundings of the entity, which copies share: of m, k go with the term. If the term were spread
    regardless of the entity, that many or more would by Hoeffding's inequality have a probability of at most 2 ** -(m KL(k/m || n(t)/N)).
    A pair counts if that, times the number of entities with two surroundings and more and of terms in two texts and more, is within
    ``chance``. A single mention is never evidence: any other word that its text alone has goes with it as well.
    """
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n_all = float(texts.count())
    words = texts.select(F.explode(_words(F.col("text"))).alias("term"), F.lit(1).alias("n"))
    words = words.union(found.select(F.explode("inner").alias("term"), F.lit(-1).alias("n")))
    counted = stored(words.groupBy("term").agg(F.sum("n").alias("n_term")).filter("n_term >= 2"))
    # Rows of one text are one, with a weight.
    held = found.filter(F.size("entities") > 0).groupBy("text_hash").agg(F.count("*").alias("weight"), F.first("entities").alias("entities"), F.first("words").alias("words"))
    held = stored(held)
    mentions = held.select("text_hash", "weight", F.explode("entities").alias("e")).groupBy("text_hash", "weight", "e.entity").agg(F.min("e.around").alias("around"))
    mentions = stored(mentions)
    each = mentions.groupBy("entity", "around").agg(F.sum("weight").alias("n"))
    entities = each.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("m")).filter("m >= 2")
    entities = stored(entities)
    n_entities, most = entities.agg(F.count("*"), F.max("n_entity")).first()
    tests = float(counted.count()) * n_entities

    # n(t, e) is n(e) at most, so a term in more texts than this cannot tell enough.
    bound = lambda n_entity: F.pow(n_entity, F.lit(disclosure)) * n_all ** (1 - disclosure) * (1 + 1e-9)
    terms = held.select("text_hash", F.explode("words").alias("term")).join(counted.filter(F.col("n_term") <= bound(F.lit(float(most or 0)))), "term")
    both = mentions.join(entities, "entity").join(terms, "text_hash").filter(F.col("n_term") <= bound(F.col("n_entity")))
    each = both.groupBy("entity", "term", "around", "n_entity", "m", "n_term").agg(F.sum("weight").alias("n"))
    pairs = each.groupBy("entity", "term", "n_entity", "m", "n_term").agg(F.sum("n").alias("n_pair"), F.count("*").alias("k"))

    told = F.log2(n_all * F.col("n_pair") / (F.col("n_term") * F.col("n_entity")))
    whole = F.log2(n_all / F.col("n_entity"))
    share, rate = F.col("k") / F.col("m"), F.col("n_term") / n_all
    apart = share * F.log2(share / rate) + F.when((share < 1) & (rate < 1), (1 - share) * F.log2((1 - share) / (1 - rate))).otherwise(0.0)
    evident = (share > rate) & (F.col("m") * apart >= math.log2(max(tests, 1.0) / chance))
    pairs = pairs.withColumn("disclosed", F.least(told / whole, F.lit(1.0)))
    return pairs.filter((whole > 0) & (F.col("disclosed") >= disclosure) & evident).select("entity", "term", "disclosed")


def _occurrences(text: Column, reveals, spans: Column) -> Column:
    """array<struct<kind, begin, end, value>> of the words of a text that ``reveals`` says yes to and that are no part of one of its base spans."""
    words = F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))
    gaps = F.slice(F.split(text, _WORD, -1), F.lit(1), F.size(words))
    both = F.zip_with(gaps, words, lambda gap, value: F.struct(F.length(gap).alias("gap"), value.alias("value")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def step(state: Column, item: Column) -> Column:
        begin, word = state["at"] + item["gap"], F.lower(item["value"])
        end = begin + F.length(item["value"])
        span = F.struct(F.lit("term").alias("kind"), begin.alias("begin"), end.alias("end"), word.alias("value"))
        # Only a hit copies the list.
        found = F.when(reveals(word), F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.alias("at"), found.alias("spans"))

    every = F.aggregate(both, start, step, lambda state: state["spans"])
    return F.filter(every, lambda w: ~F.exists(spans, lambda s: (s["begin"] <= w["begin"]) & (w["end"] <= s["end"])))


def _carried(keys: DataFrame):
    """A test of whether a string is among the column ``key`` of keys, as an expression; None if there are too many for that.

    The strings lie in the buckets of one constant, each bucket a string.
    """
    keys = keys.select("key").distinct()
    n, size = keys.agg(F.count("*"), F.sum(F.length("key") + 2)).first()
    if n > CARRIED or (size or 0) > CARRIED_CHARS:
        return None
    if not n:
        return lambda value: F.lit(False)
    number = lambda value: F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")
    buckets: list[list[str]] = [[] for _ in range(BUCKETS)]
    for r in keys.select(number(F.col("key")).alias("bucket"), "key").collect():
        buckets[r.bucket].append(r.key)
    packed = F.split(F.lit("\x1e".join("\x1f" + "\x1f".join(sorted(b)) + "\x1f" if b else "" for b in buckets)), "\x1e", -1)
    mark = F.lit("\x1f")
    return lambda value: F.contains(F.get(packed, number(value)), F.concat(mark, value, mark))


def _entities(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), F.lower(s["value"])))


def _reveals(pairs: DataFrame, everywhere: bool):
    """A function of a text's entities that gives the test of its words, or None if there are too many pairs to carry."""
    if everywhere:
        term = _carried(pairs.select(F.col("term").alias("key")))
        return term and (lambda entities: term)
    both = _carried(pairs.select(F.concat("entity", F.lit("\x1d"), "term").alias("key")))
    return both and (lambda entities: lambda word: F.exists(entities, lambda e: both(F.concat(e, F.lit("\x1d"), word))))


def _mentions(text: Column) -> Column:
    """Whether a text may hold base spans: all of them have a digit or an at sign."""
    return text.rlike("[0-9@]")


def _revealed(texts: DataFrame, found: DataFrame, pairs: DataFrame, everywhere: bool) -> DataFrame:
    """(id, text_hash, terms): the revealing terms of each text, whether it holds their entity or not if ``everywhere``."""
    if not everywhere:
        held = found.select("id", "text_hash", F.explode("entities.entity").alias("entity")).distinct()
        return held.join(pairs, "entity").groupBy("id", "text_hash").agg(F.collect_set("term").alias("terms"))
    # A word that is in most texts is dealt to PARTS tasks, by text.
    wanted = pairs.select("term").distinct().select("term", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    words = texts.select("id", "text_hash", F.pmod(F.xxhash64("id", "text_hash"), F.lit(PARTS)).cast("int").alias("part"), F.explode(_words(F.col("text"))).alias("term"))
    return words.join(wanted, ["term", "part"]).groupBy("id", "text_hash").agg(F.collect_set("term").alias("terms"))


def _among(terms: Column):
    return lambda word: F.array_contains(terms, word)


def sensitive_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, disclosure: float = DISCLOSURE, everywhere: bool = False
) -> DataFrame:
    """(real_id, id, text_hash, spans, all_spans) per row: base spans, and base spans followed by the terms that reveal.

    A revealing term counts wherever it stands in a text that holds its entity, with ``everywhere`` in every text. Texts are searched
    where they lie and not shuffled, unless there are too many terms to carry.
    """
    texts = _keyed(docs, id_col, text_col)
    found = stored(detected(docs, id_col, text_col))
    pairs = stored(disclosing(found, docs, text_col, chance, disclosure))
    if pairs.isEmpty():
        return found.select("real_id", "id", "text_hash", "spans", F.col("spans").alias("all_spans"))
    text = F.col("text")
    reveals = _reveals(pairs, everywhere)
    if reveals is not None:
        # Only texts with a hit look for their base spans again.
        hit = texts.filter(F.exists(_words(text), reveals(F.array().cast("array<string>"))) if everywhere else _mentions(text)).withColumn("base", base_spans(text))
        extra = hit.select("id", "text_hash", _occurrences(text, reveals(_entities(F.col("base"))), F.col("base")).alias("extra"))
    else:
        terms = stored(_revealed(texts, found, pairs, everywhere))
        extra = texts.join(terms, ["id", "text_hash"]).select("id", "text_hash", _occurrences(text, _among(F.col("terms")), base_spans(text)).alias("extra"))
    nothing = F.array().cast(f"array<{_SPAN}>")
    both = found.join(extra.dropDuplicates(["id", "text_hash"]), ["id", "text_hash"], "left")
    return both.withColumn("all_spans", F.concat("spans", F.coalesce("extra", nothing))).select("real_id", "id", "text_hash", "spans", "all_spans")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", everywhere: bool = False) -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, n_term, base_sha256, spans) per row; ``everywhere`` as in sensitive_spans.

    A null text is empty and has no spans. Repeated rows give equal results, null ids stay null; other columns are not read.
    """
    rows = sensitive_spans(docs, id_col, text_col, everywhere=everywhere)
    count = lambda kind: F.size(F.filter("all_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    kinds = [count(kind) for kind in (*PATTERNS, "term")]
    return rows.select(F.col("real_id").alias(id_col), *kinds, F.sha2(joined(F.col("spans")), 256).alias("base_sha256"), joined(F.col("all_spans")).alias("spans"))


def sanitised(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chance: float = CHANCE, disclosure: float = DISCLOSURE, everywhere: bool = False
) -> DataFrame:
    """docs with every span of the text replaced by its kind, as in ``[EMAIL]``; all other columns stay.

    Revealing terms go from the texts that hold their entity, with ``everywhere`` from every text.

    Spans that overlap are replaced as one, by the kind of the first. Texts without spans, and nulls, are left as they are.
    """
    found = stored(detected(docs, id_col, text_col))
    pairs = stored(disclosing(found, docs, text_col, chance, disclosure))
    text = F.col(text_col).cast("string")
    base = docs.withColumn("__base", base_spans(text))
    every = F.transform("__base", _place)
    reveals = _reveals(pairs, everywhere)
    if pairs.isEmpty():
        own = base.withColumn("__spans", F.sort_array(every))
    elif reveals is not None:
        test = reveals(_entities(F.col("__base")))
        more = F.when(F.exists(_words(text), test), F.transform(_occurrences(text, test, F.col("__base")), _place))
        own = base.withColumn("__spans", F.sort_array(F.concat(every, F.coalesce(more, F.array().cast("array<struct<begin:int,end:int,kind:string>>")))))
    else:
        terms = stored(_revealed(_keyed(docs, id_col, text_col), found, pairs, everywhere))
        unknown = F.lit(-(1 << 63)).cast("long")
        keys = {"__id": F.coalesce(F.col(id_col).cast("long"), unknown), "__hash": F.xxhash64(F.coalesce(text, F.lit("")))}
        own = base.withColumns(keys).join(terms.withColumnsRenamed({"id": "__id", "text_hash": "__hash", "terms": "__terms"}), ["__id", "__hash"], "left")
        more = F.when(F.col("__terms").isNotNull(), F.transform(_occurrences(text, _among(F.col("__terms")), F.col("__base")), _place))
        own = own.withColumn("__spans", F.sort_array(F.concat(every, F.coalesce(more, F.array().cast("array<struct<begin:int,end:int,kind:string>>")))))
    clean = _cut(text, F.col("__spans"), lambda s: F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    return own.withColumn(text_col, clean).select(*docs.columns)
