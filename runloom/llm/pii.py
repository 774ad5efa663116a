"""Personal data, and the terms that give it away.

Base entities (mail and network addresses, card and phone numbers) are found by
patterns. A document that holds one is sanitised beyond it: other words can
disclose an entity as well. How strongly a term t discloses an entity e is the
information that they share, PMI(e; t) = log p(e, t) / (p(e) p(t)), against the
information of e itself, IC(e) = -log p(e), with probabilities estimated from
the documents of the whole corpus. The difference is what stays unknown about e
once t is seen, -log2 p(e | t) bits. Terms that leave at most
``REMOVE_BITS`` are removed, those that leave at most ``GENERALISE_BITS``
are generalised; both only in documents that hold e, and only where at least
``SUPPORT`` different texts show it, so that a word which occurs once gives
nothing away by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from runloom.llm.stage import discard, staged

# The kinds in their order, with the patterns of the contract. Each is written so that it cannot
# backtrack: a match starts where its run of characters starts or where the match before ended.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = "term"
# A term is a run of at least three letters.
WORD = r"\p{L}{3,}+"
SUPPORT = 3
REMOVE_BITS, GENERALISE_BITS = 0.5, 1.0
REMOVE, GENERALISE = "remove", "generalise"
_SPANS = "array<struct<start: int, kind: int, end: int, value: string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string of moderate length has a valid check digit."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return total + digit - F.when(digit > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_PART}\.{_PART}\.{_PART}\.{_PART}$")
    if kind == "card":
        digits = _digits(value)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_runs(items: Column, kind: str, step, finish) -> Column:
    """Fold an array whose steps append to a list (``out`` of the state, of type ``kind``; ``at`` counts from 0).

    Appending copies what is there, which over a whole array would cost its
    square. So runs of about the square root of its length are folded by
    themselves, and only finished runs are put together.
    """
    none, nothing = F.array().cast(kind), F.array().cast(f"array<{kind}>")

    def whole(done: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(done["at"].alias("at"), none.alias("out")), step)
        return _once(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(done["out"], F.array(x["out"])).alias("out")))

    def fold(items: Column) -> Column:
        size = F.size(items)
        run = F.greatest(F.lit(32), F.ceil(F.sqrt(size)).cast("int"))
        last = F.floor((F.greatest(size, F.lit(1)) - 1) / run).cast("int")
        runs = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * run + 1, run))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), nothing.alias("out")), whole, lambda done: finish(done["at"], F.flatten(done["out"])))

    return _once(items, fold)


def _found(text: str, kind: str) -> Column:
    """Spans of one kind, from what lies between its matches and the matches themselves."""
    parts = F.arrays_zip(F.split(text, PATTERNS[kind], -1).alias("gap"), F.col(f"hits_{kind}").alias("hit"))

    def step(state: Column, part: Column) -> Column:
        start = state["at"] + F.length(part["gap"])
        end = start + F.length(part["hit"])
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), part["hit"].alias("value"))
        spans = F.when(part["hit"].isNotNull() & _passes(kind, part["hit"]), F.concat(state["out"], F.array(span))).otherwise(state["out"])
        return F.struct(F.coalesce(end, start).alias("at"), spans.alias("out"))

    found = _in_runs(parts, _SPANS, step, lambda at, spans: spans)
    return F.when(F.size(f"hits_{kind}") > 0, found).otherwise(F.array().cast(_SPANS))


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``base``: the base spans (start, kind, end, value) by start, then kind. Places count code points."""
    may = {"email": "@", "ip": ".", "phone": "+"}
    hits = {}
    for kind in KINDS:
        found = F.regexp_extract_all(F.col(text_col), F.lit(PATTERNS[kind]), F.lit(0))
        hits[f"hits_{kind}"] = F.when(F.contains(F.col(text_col), F.lit(may[kind])), found).otherwise(F.array().cast("array<string>")) if kind in may else found
    rows = docs.withColumns(hits)
    rows = rows.withColumn("base", F.array_sort(F.concat(*[_found(text_col, kind) for kind in KINDS])))
    return rows.drop(*hits)


def disclosures(sensitive: DataFrame, docs: DataFrame, support: int = SUPPORT, bits: float = GENERALISE_BITS) -> DataFrame:
    """(entity, term, action): the terms that disclose an entity.

    ``sensitive`` has a row for each document with base entities: print (of its
    text), entities, terms. Equal texts are one witness. How often a term occurs
    at all is counted in every document.
    """
    # Equal texts have equal lists, so any of them will do.
    texts = staged(sensitive.groupBy("print").agg(F.first("entities").alias("entities"), F.first("terms").alias("terms")), "witnesses")
    known = texts.select("print", F.explode("entities").alias("entity"))
    common = staged(known.groupBy("entity").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("entity"), "entities")
    known = staged(known.join(common, "entity").select("print", "entity"), "known")
    pairs = known.join(texts.select("print", "terms"), "print").select("entity", F.explode("terms").alias("term"))
    pairs = staged(pairs.groupBy("entity", "term").agg(F.count("*").alias("n")).filter(F.col("n") >= support), "pairs", free=True)
    words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0)))).alias("term"))
    counted = words.groupBy("term").agg(F.count("*").alias("total"))
    unknown = -F.log2(F.least(F.lit(1.0), F.col("n") / F.col("total")))
    telling = pairs.join(counted, "term").withColumn("unknown", unknown).filter(F.col("unknown") <= bits)
    action = F.when(F.col("unknown") <= REMOVE_BITS, REMOVE).otherwise(GENERALISE)
    telling = staged(telling.select("entity", "term", action.alias("action")), "telling", free=True)
    discard(texts, common, known, pairs)
    return telling


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, bits: float = GENERALISE_BITS) -> DataFrame:
    """One row per row of ``docs``: doc_id, base, terms, clean_text.

    ``base`` and ``terms`` are spans (start, kind, end, value) by start; the
    kind is a place in ``KINDS``, -1 for a term to remove and -2 for one to
    generalise. In ``clean_text`` base spans are replaced by their kind in
    brackets, terms by nothing or by ``[term]``; of overlapping base spans the
    first is named. Null texts are empty and have no spans. Spans of one kind do
    not overlap; of several kinds they may, and terms that touch a base span are
    none. A term that discloses several entities is removed if one asks for it.
    Repeated rows each get a row, and equal texts count once as evidence, however
    many copies there are. Rows without an id are treated like others; an empty
    table gives an empty one. In a text of n matches, finding places costs
    n^1.5 copied references; each disclosing term found in a text is compared
    with that text's base spans.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spotted = with_base_spans(docs)
    hidden = F.regexp_replace("text", PATTERNS["email"], " ")
    sensitive = spotted.filter(F.size("base") > 0).select(
        F.md5("text").alias("print"), "text", "base",
        F.array_distinct(F.transform("base", lambda s: F.lower(s["value"]))).alias("entities"),
        F.array_distinct(F.regexp_extract_all(F.lower(hidden), F.lit(WORD), F.lit(0))).alias("terms"),
    )
    # What a text gives away follows from the text, so equal texts are handled once.
    sensitive = staged(sensitive.dropDuplicates(["print"]), "sensitive", free=True)
    telling = disclosures(sensitive.select("print", "entities", "terms"), docs, support, bits)
    own = sensitive.select("print", F.explode("entities").alias("entity")).join(telling, "entity")
    # "remove" is the greater word.
    own = staged(own.groupBy("print", "term").agg(F.max("action").alias("action")), "own")
    wanted = staged(own.select("print").distinct(), "wanted")
    texts = sensitive.join(wanted, "print", "left_semi").select("print", "base", F.posexplode(F.arrays_zip(
        F.split("text", WORD, -1).alias("gap"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("word"))).alias("i", "part"))
    size = F.length("part.gap") + F.coalesce(F.length("part.word"), F.lit(0))
    before = Window.partitionBy("print").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("part.gap")).cast("int")
    placed = texts.select("print", "base", start.alias("start"), F.col("part.word").alias("value")).filter("value is not null")
    placed = placed.withColumn("term", F.lower("value")).join(own, ["print", "term"])
    end = F.col("start") + F.length("value")
    apart = ~F.exists("base", lambda s: (s["start"] < end) & (F.col("start") < s["end"]))
    kind = F.when(F.col("action") == REMOVE, -1).otherwise(-2)
    span = F.struct("start", kind.alias("kind"), end.alias("end"), "value")
    terms = staged(placed.filter(apart).groupBy("print").agg(F.array_sort(F.collect_list(span)).alias("terms")), "terms", free=True)
    rows = spotted.withColumn("print", F.when(F.size("base") > 0, F.md5("text"))).join(terms, "print", "left")
    rows = rows.select("doc_id", "text", "base", F.coalesce("terms", F.array().cast(_SPANS)).alias("terms"))
    return rows.select("doc_id", "base", "terms", _clean().alias("clean_text"))


# Code points of a piece of text. Places are counted from the start of a text, which is long for a late one.
_PIECE = 4096


def _clean() -> Column:
    def cleaned(pieces: Column) -> Column:
        def between(low: Column, size: Column) -> Column:
            first, last = F.floor(low / _PIECE).cast("int"), F.floor((low + size) / _PIECE).cast("int")
            near = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
            return F.when(size > 0, F.substring(near, low - first * _PIECE + 1, size)).otherwise("")

        def step(state: Column, span: Column) -> Column:
            name = F.when(span["kind"] == -1, "").when(span["kind"] == -2, f"[{TERM}]").otherwise(
                F.concat(F.lit("["), F.element_at(F.array(*map(F.lit, KINDS)), F.greatest(span["kind"], F.lit(0)) + 1), F.lit("]")))
            fresh = span["start"] >= state["at"]
            part = F.concat(between(state["at"], span["start"] - state["at"]), name)
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"),
                            F.when(fresh, F.concat(state["out"], F.array(part))).otherwise(state["out"]).alias("out"))

        return _in_runs(F.array_sort(F.concat("base", "terms")), "array<string>", step, lambda at, out: F.concat(
            F.array_join(out, ""), F.substring(F.col("text"), at + 1, F.length("text"))))

    last = F.floor(F.length("text") / _PIECE).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda k: F.substring("text", k * _PIECE + 1, F.lit(_PIECE)))
    return F.when(F.size("base") + F.size("terms") > 0, _once(pieces, cleaned)).otherwise(F.col("text"))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of spans, comma-joined."""
    names = F.array(*[F.lit(kind) for kind in KINDS])
    name = lambda s: F.when(s["kind"] < 0, TERM).otherwise(F.element_at(names, F.greatest(s["kind"], F.lit(0)) + 1))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
