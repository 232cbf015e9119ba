"""Personal data: base patterns, and information-theoretic sanitisation of the terms around them. DataFrame functions only.

Base: e-mail addresses, IP addresses, card and phone numbers, leftmost and not overlapping within a kind; a match that
fails its check is dropped. Their values are the protected entities. How strongly a term reveals an entity is estimated
from the whole corpus: with n documents, n_c that hold entity c, n_t that hold term t and n_ct that hold both, the
pointwise mutual information is log2(n_ct * n / (n_c * n_t)) and the entity's own information is log2(n / n_c). A term
whose mutual information reaches `alpha` times that information discloses the entity: it is masked (generalised to its
class) at all its places in the documents that name the entity, along with the base spans. Documents that only hold the
term stay as they are: they name no entity that it could disclose, and each of them lowers its information. Every pair that occurs is judged, however rare:
counts are smoothed by half a document, so an entity of one document has its rare terms masked (those of up to about
n ** (1 - alpha) documents). With `each_copy` n_ct counts every document, as n_c and n_t do: a text that was copied has
its pairs judged as if it stood once, so no pair that reaches the threshold is left out; op4_pii and the pipeline do so.
Without it n_ct counts a text once, so that copies show little, and pairs seen in copies only stay. A caller that wants a
hard minimum instead gives `min_contexts`: as many different windows of WINDOW code points around mentions, and as many
documents, must show the pair; counts are not smoothed, and terms are masked in these windows only.

No pair of documents is formed. A document's entities meet only those of its terms that are rare enough to disclose one:
mutual information is at most log2(n / n_t), which drops the common terms before any pair is made. Counts combine in each
task before they are shuffled.

Defined results: null text counts as empty and has no spans; texts of any length are taken whole; spans that start at one
place are ordered by kind; a null doc_id is passed on; repeated rows are judged alike and count as documents each; an empty
table gives an empty result; other columns pass through whatever their names, but for those that begin with two underscores.
Texts without base spans are left unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docflow.llm.shared import BLOCK, ROW, at_rows, by_block, discard, id_of, materialize, numbered, text_of
from docflow.llm.shared import located as located_rows

KINDS = ("email", "ip", "card", "phone", "term")
# Possessive quantifiers and look-behinds keep the matches of the plain patterns, and their cost linear in the text:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+    card [0-9]([\x20-]?[0-9])+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)                 phone \+[0-9][\x20().0-9-]+[0-9]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
IP_PARTS = rf"^{_PART}(?:\.{_PART}){{3}}$"
#: A term: letters between white space, quotes and punctuation.
TERM = r"(?<![^\s\"'(\[«“])\p{L}[\p{L}-]{2,}(?=[.,;:!?)\"'\]»”]*+(?:\s|$))"
#: Code points of context on either side of a mention, for a hard minimum of contexts.
WINDOW = 100
ALPHA = 0.9
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the pattern's matches, in code points: what lies between the matches gives the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), m.alias("value")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    step = lambda a, x: F.struct(
        (a["at"] + x["gap"] + x["n"]).alias("at"),
        F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"))).alias("out"),
    )
    return F.when(F.regexp_like(text, F.lit(pattern)), F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(IP_PARTS))
    if kind == "card":
        digits = _digits(value)
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """array<struct<start, kind (number in KINDS), end, value>>, sorted: value is the entity, normalised."""

    def spans(number: int, kind: str) -> Column:
        entity = F.lower if kind == "email" else (lambda v: v) if kind == "ip" else _digits
        kept = F.filter(located(text, PATTERNS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(kept, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"), entity(m["value"]).alias("value")))

    return F.array_sort(F.concat(*(spans(number, kind) for number, kind in enumerate(KINDS[:4]))))


def listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")


def _windows(text: Column, spans: Column) -> Column:
    """Around each span: entity (kind and value), and the pieces before and after with the place where each starts."""

    def window(s: Column) -> Column:
        begin = F.greatest(s["start"] - WINDOW, F.lit(0))
        before = F.substring(text, begin + 1, s["start"] - begin)
        whole = F.when(begin > 0, F.regexp_replace(before, r"^\S+", "")).otherwise(before)  # a word that is cut is left out
        after = F.substring(text, s["end"] + 1, F.lit(WINDOW))
        after = F.when(F.length(after) == WINDOW, F.regexp_replace(after, r"\S+$", "")).otherwise(after)
        return F.struct(_entity(s).alias("entity"), whole.alias("before"), (begin + F.length(before) - F.length(whole)).alias("before_at"), after.alias("after"), s["end"].alias("after_at"))

    return F.transform(spans, window)


def detected(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """row (a number), doc_id, text_key, base, and the text where it has base spans: written to the shared folder."""
    found = docs.select(id_of(doc_id).alias("doc_id"), text_of(text).alias("text")).withColumn("base", base_spans(F.col("text")))
    some = F.size("base") > 0
    return materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(some, F.sha2("text", 256)).alias("text_key"), "base", F.when(some, F.col("text")).alias("text")), "pii-base")


def _terms_of(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _entity(s: Column) -> Column:
    return F.concat_ws(":", s["kind"], s["value"])


def _counts(docs: DataFrame, found: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """entity, n_c; and term, n_t."""
    entities = found.where("text_key IS NOT NULL").select(F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity")).groupBy("entity").agg(F.count("*").alias("n_c"))
    terms = docs.select(F.explode(_terms_of(text_of(text))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t"))
    return entities, terms


def terms_located(text: Column, terms: Column) -> Column:
    """array<struct<start, kind, end>> of the places of these terms (lower case)."""
    found = F.regexp_extract_all(text, F.lit(TERM), F.lit(0))
    pairs = F.zip_with(found, F.slice(F.split(text, TERM, -1), F.lit(1), F.size(found)), lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m).alias("n"), F.array_contains(terms, F.lower(m)).alias("held")))
    step = lambda a, x: F.struct(
        (a["at"] + x["gap"] + x["n"]).alias("at"),
        F.when(x["held"], F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), F.lit(4).alias("kind"), (a["at"] + x["gap"] + x["n"]).alias("end")))).otherwise(a["out"]).alias("out"),
    )
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out")), step, lambda a: a["out"])


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str = "text", alpha: float = ALPHA, min_contexts: int | None = None, n_docs: int | None = None, each_copy: bool = False) -> DataFrame:
    """text_key, terms array<struct<start, kind, end>>: the terms to mask in each text that has base spans. n_docs: if found holds those texts only."""
    n_docs = found.count() if n_docs is None else n_docs
    if min_contexts is not None:
        return _disclosing_in_windows(docs, found, text, alpha, min_contexts, n_docs)
    entities, terms = _counts(docs, found, text)
    entities = materialize(entities, "pii-entities")
    n = F.lit(n_docs + 1.0)
    own = F.log2(n / (F.col("n_c") + 0.5))
    bound = F.log2(n / (F.col("n_t") + 0.5))
    texts = found.where("text_key IS NOT NULL").groupBy("text_key").agg(F.first("base").alias("base"), F.first("text").alias("text"), (F.count("*") if each_copy else F.lit(1).cast("long")).alias("n_rows"))
    texts = materialize(texts.select("text_key", "n_rows", "text", F.array_distinct(F.transform("base", _entity)).alias("entities")), "pii-texts")
    named = texts.select("text_key", "n_rows", F.explode("entities").alias("entity")).join(entities, "entity").where(own > 0)
    named = materialize(named, "pii-named")
    least = named.groupBy("text_key").agg((alpha * F.min(own)).alias("least"))
    rare = texts.select("text_key", F.explode(_terms_of(F.col("text"))).alias("term")).join(terms, "term").join(least, "text_key").where(bound >= F.col("least"))
    pairs = materialize(rare.select("text_key", "term", "n_t").join(named, "text_key").where(bound >= alpha * own).select("text_key", "n_rows", "entity", "term", "n_c", "n_t"), "pii-pairs")
    shown = pairs.groupBy("entity", "term", "n_c", "n_t").agg(F.sum("n_rows").alias("n_ct"))
    disclosing = shown.where(F.log2((F.col("n_ct") + 0.5) * n / ((F.col("n_c") + 0.5) * (F.col("n_t") + 0.5))) >= alpha * own).select("entity", "term")
    sets = pairs.join(disclosing, ["entity", "term"]).groupBy("text_key").agg(F.collect_set("term").alias("held"))
    return texts.join(sets, "text_key").select("text_key", terms_located(F.col("text"), F.col("held")).alias("terms"))


def _disclosing_in_windows(docs: DataFrame, found: DataFrame, text: str, alpha: float, min_contexts: int, n_docs: int) -> DataFrame:
    windows = found.where("text_key IS NOT NULL").select("row", "text_key", F.explode(_windows(F.col("text"), F.col("base"))).alias("w"))
    mentions = windows.select("row", "text_key", "w.*", F.xxhash64(F.lower("w.before"), F.lower("w.after")).alias("context"))
    placed = lambda piece: F.transform(located(F.col(piece), TERM), lambda m: F.struct((m["start"] + F.col(f"{piece}_at")).alias("start"), (m["end"] + F.col(f"{piece}_at")).alias("end"), F.lower(m["value"]).alias("term")))
    near = materialize(mentions.select("row", "text_key", "entity", "context", F.explode(F.concat(placed("before"), placed("after"))).alias("t")).select("row", "text_key", "entity", "context", "t.*"), "pii-contexts")
    pairs = near.groupBy("entity", "term").agg(F.count_distinct("row").alias("n_ct"), F.count_distinct("context").alias("contexts")).where((F.col("contexts") >= min_contexts) & (F.col("n_ct") >= min_contexts))
    entities, terms = _counts(docs, found, text)
    n = F.lit(n_docs)
    judged = pairs.join(entities, "entity").join(terms, "term")
    own = F.log2(n / F.col("n_c"))
    disclosing = judged.where((own > 0) & (F.log2(F.col("n_ct") * n / (F.col("n_c") * F.col("n_t"))) >= alpha * own)).select("entity", "term")
    masked = near.join(disclosing, ["entity", "term"]).select("text_key", "start", "end").distinct()
    return masked.groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", F.lit(4).alias("kind"), "end"))).alias("terms"))


def _plain(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def spans_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA, min_contexts: int | None = None, each_copy: bool = False) -> DataFrame:
    """Per row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (all, listed as kind:start:end), n_term."""
    found = detected(docs, text, doc_id)
    terms = disclosing_terms(docs, found, text, alpha, min_contexts, each_copy=each_copy)
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    clean, some = found.where("text_key IS NULL").withColumn("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>")), found.where("text_key IS NOT NULL")
    both = clean.select("doc_id", "base", "terms").unionByName(some.join(terms, "text_key", "left").select("doc_id", "base", "terms"))
    every = F.array_sort(F.concat(_plain(F.col("base")), F.coalesce("terms", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    return both.select("doc_id", *map(number, KINDS[:4]), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(every).alias("spans"), F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("n_term"))


def masked_text(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind's mask; of overlapping spans the first gives the mask, and all are covered."""
    masks = F.array(*(F.lit(MASKS[k]) for k in KINDS))
    step = lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(
        F.struct(
            s["end"].alias("at"),
            F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))), F.when(s["start"] < a["at"], F.lit("")).otherwise(F.element_at(masks, s["kind"] + 1))).alias("out"),
        )
    )
    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", alpha: float = ALPHA, min_contexts: int | None = None, each_copy: bool = False) -> DataFrame:
    """docs with base spans and disclosing terms masked in the text; the columns of docs. Patterns are looked for once; terms are sent to the rows' blocks, no text is moved for it."""
    some = F.size("__base") > 0
    table = numbered(docs.withColumn("__base", base_spans(text_of(text))), "pii-rows")
    held = table.where(some).select(F.col(ROW).alias("row"), F.sha2(text_of(text), 256).alias("text_key"), F.col("__base").alias("base"), text_of(text).alias("text"))
    found = materialize(held, "pii-base")
    terms = disclosing_terms(docs, found, text, alpha, min_contexts, table.select(BLOCK).count(), each_copy)
    facts = located_rows(found.select(F.col("row").alias(ROW), "text_key").join(terms.select("text_key", F.col("terms").alias("__terms")), "text_key").drop("text_key"))
    every = F.array_sort(F.concat(_plain(F.col("__base")), F.coalesce("__terms", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    masked = F.when(F.size("__base") > 0, masked_text(F.col(text), every)).otherwise(F.col(text)).alias(text)
    with by_block(docs.sparkSession):
        result = materialize(at_rows(table, facts, "left").select(*(masked if c == text else F.col(c) for c in docs.columns)), "pii-sanitised")
    discard(table, found)
    return result
