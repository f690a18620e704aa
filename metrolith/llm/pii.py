"""Personal data: base patterns and information-theoretic sanitisation, in
DataFrame functions only.

Base spans come from four patterns. What the patterns cannot see are words
that give an entity away because they keep company with it. For every entity
``e`` (a distinct value of a base span) and every term ``t`` (a run of letters,
marks, digits and underscores outside base spans) the corpus gives

    information(e)  = -log p(e)
    disclosure(e,t) = log(p(e, t) / (p(e) p(t))) / information(e)

with probabilities over whole documents: 1 means that ``t`` reveals ``e``
completely. Terms at or above ``threshold`` that share ``support`` documents or
more with the entity are spans of kind ``term``, at each of their occurrences
in documents that hold the entity or, with ``everywhere``, in all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

KINDS = ("email", "ip", "card", "phone", "term")
#: Java forms of the patterns: possessive where nothing is lost by it, and
#: anchored so that a run of characters is tried once, not from each of them.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_TERM = r"[\p{L}\p{M}\p{N}_]++"

_SPAN = "struct<start:int,`end`:int,m:string>"


#: Matches are handled in chunks of this many, so that an array is never grown one by
#: one over all the matches of a long text.
_CHUNK = 64


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` standing for the value, which is made once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _chunks(array: str) -> str:
    return f"transform(sequence(0, greatest(size({array}) - 1, 0) div {_CHUNK}), k -> slice({array}, k * {_CHUNK} + 1, {_CHUNK}))"


def _matched(text: str, pattern: str, fields: str, kind: str, test: str = "true") -> str:
    """SQL for an array of ``fields`` (of type ``kind``) of the matches x that pass a
    test; x.m is the match and acc.pos + x.gap its first code point.

    Positions follow from the lengths of the matches and of the stretches between."""
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = f"filter(zip_with(regexp_extract_all({text}, '{p}', 0), split({text}, '{p}', -1), (m, b) -> struct(m, length(b) AS gap, length(m) AS size)), x -> x.m IS NOT NULL)"
    first = "aggregate(c, struct(0 AS pos, CAST(array() AS array<int>) AS out), (acc, y) -> struct(acc.pos + aggregate(y, 0, (n, x) -> n + x.gap + x.size) AS pos, concat(acc.out, array(acc.pos)) AS out), acc -> acc.out)"
    one = (
        f"aggregate(y, struct(at AS pos, CAST(array() AS array<{kind}>) AS out),"
        f" (acc, x) -> struct(acc.pos + x.gap + x.size AS pos, CASE WHEN {test} THEN concat(acc.out, array({fields})) ELSE acc.out END AS out), acc -> acc.out)"
    )
    return _let("z", found, _let("c", _chunks("z"), f"flatten(zip_with(c, {first}, (y, at) -> {one}))"))


def _found(text: str, pattern: str) -> str:
    """SQL for array<struct<start, end, m>> of all matches, in code points."""
    return _matched(text, pattern, "struct(acc.pos + x.gap AS start, acc.pos + x.gap + x.size AS `end`, x.m AS m)", _SPAN)


def _rewritten(spans: str, step: str) -> str:
    """SQL for the text with its sorted spans rewritten: ``step`` is what a span s adds to
    the strings acc.out; acc.pos is where the spans before it end, and
    ``part`` the stretch of text from ``at`` on that holds the chunk."""
    last = "greatest({0}, coalesce(array_max(transform(y, s -> s.`end`)), 0))"
    first = f"aggregate(c, struct(0 AS pos, CAST(array() AS array<int>) AS out), (acc, y) -> struct({last.format('acc.pos')} AS pos, concat(acc.out, array(acc.pos)) AS out))"
    one = f"array_join(aggregate(y, struct(at AS pos, CAST(array() AS array<string>) AS out), (acc, s) -> struct(greatest(acc.pos, s.`end`) AS pos, {step} AS out), acc -> acc.out), '')"
    pieces = f"zip_with(c, w.out, (y, at) -> {_let('part', f'substring(text, at + 1, {last.format('at')} - at)', one)})"
    return _let("c", _chunks(spans), _let("w", first, f"concat(array_join({pieces}, ''), substring(text, w.pos + 1))"))


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(d: str) -> str:
    digit = f"CAST(substring({d}, length({d}) - i + 1, 1) AS int)"
    return f"aggregate(sequence(1, length({d})), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN {digit} ELSE 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END END) % 10 = 0"


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key, text, spans: array of (start, kind_no, end, kind, m), in order.

    ``key`` names a row by its id and text; a null text counts as empty."""
    none = f"CAST(array() AS array<{_SPAN}>)"
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("key", F.xxhash64("doc_id", "text")).withColumn("digit", F.col("text").rlike("[0-9]"))
    part = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$".replace("\\", "\\\\")
    found = {
        "email": f"CASE WHEN contains(text, '@') THEN {_found('text', _EMAIL)} ELSE {none} END",
        "ip": f"CASE WHEN digit AND contains(text, '.') THEN filter({_found('text', _IP)}, x -> forall(split(x.m, '\\\\.'), p -> p rlike '{part}')) ELSE {none} END",
        "card": f"CASE WHEN digit THEN filter(filter({_found('text', _CARD)}, x -> length({_digits('x.m')}) BETWEEN 12 AND 19), x -> {_luhn(_digits('x.m'))}) ELSE {none} END",
        "phone": f"CASE WHEN digit AND contains(text, '+') THEN filter({_found('text', _PHONE)}, x -> length({_digits('x.m')}) BETWEEN 9 AND 15) ELSE {none} END",
    }
    t = t.withColumns({k: F.expr(v) for k, v in found.items()})
    tagged = ", ".join(f"transform({k}, x -> struct(x.start AS start, {i} AS no, x.`end` AS `end`, '{k}' AS kind, x.m AS m))" for i, k in enumerate(KINDS[:4]))
    return t.select("doc_id", "key", "text", F.expr(f"array_sort(concat({tagged}))").alias("spans"))


def _masked() -> str:
    """SQL for the text with its base spans blanked; positions stay."""
    blank = "substring(part, acc.pos - at + 1, greatest(s.start - acc.pos, 0)), repeat(' ', s.`end` - greatest(s.start, acc.pos))"
    return f"CASE WHEN size(spans) = 0 THEN text ELSE {_rewritten('spans', f'CASE WHEN s.`end` > acc.pos THEN concat(acc.out, array({blank})) ELSE acc.out END')} END"


def _terms() -> str:
    """SQL for the distinct terms of a row outside its base spans, as hashes."""
    p = _TERM.replace("\\", "\\\\")
    return f"array_distinct(transform(regexp_extract_all(masked, '{p}', 0), x -> xxhash64(lower(x))))"


def _flagged() -> str:
    """SQL for the spans of the terms in ``flags``; no others are collected."""
    span = "struct<start:int,no:int,`end`:int,kind:string>"
    fields = "struct(acc.pos + x.gap AS start, 4 AS no, acc.pos + x.gap + x.size AS `end`, 'term' AS kind)"
    return f"CASE WHEN flags IS NULL THEN CAST(array() AS array<{span}>) ELSE {_matched('masked', _TERM, fields, span, 'array_contains(flags, xxhash64(lower(x.m)))')} END"


def _based(docs: DataFrame) -> DataFrame:
    """doc_id, key, spans and the masked text of each row, written."""
    t = base_spans(docs).withColumn("masked", F.expr(_masked()))
    return written(t.select("doc_id", "key", "spans", "masked"), "base")


def disclosing(based: DataFrame, threshold: float, support: int) -> tuple[DataFrame, DataFrame]:
    """(entity, term: the pairs at or above the disclosure threshold; key, entity,
    term: the candidates in each row).

    All counts are numbers of whole documents (rows of distinct key) over the
    corpus. As ``p(e,t) <= p(e)``, a term of ``e`` is in ``total * p(e)^threshold``
    documents at most: terms are counted first, and commoner ones make no pairs."""
    twice = written(based.groupBy("key").count().where("count > 1").select("key"), "twice")
    once = based
    if not twice.isEmpty():
        once = based.join(twice, "key", "left_anti").unionByName(based.join(twice, "key", "left_semi").dropDuplicates(["key"]))
    total = float(once.count())
    entities = once.where(F.size("spans") > 0).select("key", F.explode(F.expr("array_distinct(transform(spans, s -> xxhash64(s.kind, lower(s.m))))")).alias("entity"))
    of_entity = entities.groupBy("entity").agg(F.count("*").alias("with_entity")).where((F.col("with_entity") >= support) & (F.col("with_entity") < total))
    #: a little is added for rounding: the exact test comes last
    most = F.lit(max(total, 1.0)) * F.pow(F.col("with_entity") / max(total, 1.0), F.lit(threshold)) * 1.000001
    held = written(entities.join(of_entity.withColumn("most", most), "entity"), "entities")
    bound = held.agg(F.max("most")).first()[0] or 0.0
    words = once.select(F.explode(F.expr(_terms())).alias("term"))
    of_term = words.groupBy("term").agg(F.count("*").alias("with_term")).where(F.col("with_term").between(support, bound))
    rows = once.where(F.size("spans") > 0).join(held.groupBy("key").agg(F.max("most").alias("row_most")), "key")
    rare = rows.select("key", "row_most", F.explode(F.expr(_terms())).alias("term")).join(small(of_term, 500_000), "term").where("with_term <= row_most")
    pairs = written(rare.select("key", "term", "with_term").join(held, "key").where("with_term <= most").select("key", "entity", "term", "with_entity", "with_term"), "pairs")
    scored = pairs.groupBy("entity", "term", "with_entity", "with_term").agg(F.count("*").alias("both")).where(F.col("both") >= support)
    pmi = F.log(F.col("both") * F.lit(total) / (F.col("with_entity") * F.col("with_term")))
    return scored.where(pmi >= threshold * F.log(F.lit(total) / F.col("with_entity"))).select("entity", "term"), pairs.select("key", "entity", "term")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, threshold: float = 0.8, support: int = 3, everywhere: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for each row.

    ``everywhere`` marks a disclosing term also in rows without the entity.
    Null and empty texts have no spans; repeated rows get equal results and
    count as one document in the corpus. Empty table: no rows.
    """
    based = _based(docs)
    out = based.join(term_flags(based, threshold, support, everywhere), "key", "left").withColumn("terms", F.expr(_flagged()))
    n = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    both = F.array_sort(F.concat(F.expr("transform(spans, s -> struct(s.start AS start, s.no AS no, s.`end` AS `end`, s.kind AS kind))"), "terms"))
    return out.select("doc_id", n("email"), n("ip"), n("card"), n("phone"), F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"), _joined(both).alias("spans"))


def term_flags(based: DataFrame, threshold: float, support: int, everywhere: bool) -> DataFrame:
    """key, flags: the disclosing terms of each row that has some, as hashes."""
    pairs, held = disclosing(based, threshold, support)
    if everywhere:
        terms = small(pairs.select("term").distinct(), 500_000)
        hits = based.select("key", F.explode(F.expr(_terms())).alias("term")).join(terms, "term")
    else:
        hits = held.join(pairs, ["entity", "term"])
    return hits.groupBy("key").agg(F.collect_set("term").alias("flags"))


def redact(docs: DataFrame, threshold: float = 0.8, support: int = 3, everywhere: bool = False) -> DataFrame:
    """The documents with every span replaced by its kind in brackets, and n_chars
    set to the new length. Null texts stay null; columns and their order stay."""
    based = _based(docs)
    full = based.join(term_flags(based, threshold, support, everywhere), "key", "left").where("size(spans) > 0 OR flags IS NOT NULL").dropDuplicates(["key"]).withColumn("terms", F.expr(_flagged()))
    spans = full.select("key", F.expr("array_sort(concat(transform(spans, s -> struct(s.start AS start, s.no AS no, s.`end` AS `end`, s.kind AS kind)), terms))").alias("__all"))
    keyed = docs.withColumn("__key", F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))))
    out = keyed.join(small(spans.withColumnRenamed("key", "__key"), 100_000), "__key", "left")
    cut = F.expr(_rewritten("__all", "CASE WHEN s.start >= acc.pos THEN concat(acc.out, array(substring(part, acc.pos - at + 1, s.start - acc.pos), concat('[', upper(s.kind), ']'))) ELSE acc.out END"))
    out = out.withColumn("text", F.when(F.col("__all").isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__all").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
